"""Spark-native context retrieval, impact analysis and corpus processing."""
