"""Spark-native entity resolution and evidence analytics."""

__version__ = "0.1.0"
