"""Spark-native document-evidence analytics and training-data operators."""
