"""Spark-native lossless columnar encoding and encoding analytics over event tables."""
