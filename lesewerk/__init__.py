"""Spark-native preparation, measurement and curation of long-form text and recording metadata."""

__version__ = "0.1.0"
