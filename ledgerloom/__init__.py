"""Spark-native analytics over semi-structured filings, schedules and web pages."""

__version__ = "0.1.0"
