"""Spark-native document retrieval and hypervector analytics."""

__version__ = "0.1.0"
