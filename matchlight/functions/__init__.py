"""Part of matchlight."""
