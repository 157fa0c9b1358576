"""Spark-native engine for describing, checking, profiling and generating structured data."""

__version__ = "0.1.0"
