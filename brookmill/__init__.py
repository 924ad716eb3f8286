"""Spark-native engine for event streams and training corpora."""
