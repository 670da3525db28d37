"""Spark-native normalisation, scoring, routing and curation of security alerts."""

__version__ = "0.1.0"
