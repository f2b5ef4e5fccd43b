"""Spark-native engine for building and evaluating retrieval test collections."""

__version__ = "0.1.0"
