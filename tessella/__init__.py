"""Tessella: a Spark-native engine for the data side of post-training pipelines."""
