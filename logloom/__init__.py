"""Spark-native log analytics: enrichment, aggregation, delivery and log-data preparation."""

__version__ = "0.1.0"
