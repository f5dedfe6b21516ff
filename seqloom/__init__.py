"""Spark-native analytics over intervals, sequences and line-oriented records."""

__version__ = "0.1.0"
