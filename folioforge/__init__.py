"""Spark-native analytics over web pages, their blocks and site files."""

__version__ = "0.1.0"
