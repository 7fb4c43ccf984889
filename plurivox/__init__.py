"""Spark-native analytics for large collections of free-text contributions."""
