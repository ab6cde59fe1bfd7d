"""Operators on text collections. Nothing else in the library imports this package."""
