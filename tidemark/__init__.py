"""Spark-native analytics over timestamped text posts."""
