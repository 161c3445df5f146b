"""Spark-native record linkage and corpus engine."""
