"""Spark-native analytics over ordered-coordinate data."""
