"""A Spark-native knowledge-graph engine for source code."""

__version__ = "0.1.0"
