"""Spark-native analytics for corpora of documents, generated programs and experiment results."""
