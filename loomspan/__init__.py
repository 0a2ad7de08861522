"""Spark-native synthetic trace engine."""
