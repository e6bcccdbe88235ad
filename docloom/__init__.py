"""Spark-native document, vector and conversation analytics."""

__version__ = "0.1.0"
