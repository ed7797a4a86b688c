"""lumberline: a PySpark-native engine for log analysis and text data at scale."""

__version__ = "0.1.0"
