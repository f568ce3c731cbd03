"""Spark-native minimum spanning forests, and operators for training-data pipelines."""
