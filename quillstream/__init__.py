"""Spark-native engine for document extraction, listing algebra and data preparation."""

__version__ = "0.1.0"
