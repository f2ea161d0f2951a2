"""Spark-native analytics over labelled three-dimensional volumes."""
