"""Spark-native engine for per-entity signals, embedding vectors and training-data corpora."""
