"""Spark-native retrieval, document and reference-integrity analytics."""
