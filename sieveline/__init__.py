"""Sieveline: a Spark-native engine for two-stage retrieval, ranking and corpus analytics."""
