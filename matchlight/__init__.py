"""Spark-native retrieval analytics: descriptors, metrics, ranking and evaluation."""
