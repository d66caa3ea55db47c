"""Tidemark: a PySpark-native analytics engine for market time series and event streams."""

__version__ = "0.1.0"
