"""Spark-native corpus, evaluation and training-data analytics."""
