"""Spark-native analytics for auditing representation and performance gaps."""
