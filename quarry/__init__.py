"""Spark-native jobs for building, checking and evaluating structured-extraction data."""
