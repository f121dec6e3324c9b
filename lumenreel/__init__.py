"""Spark-native media-library analytics: DataFrame operators, sources, sinks and streaming plans."""
