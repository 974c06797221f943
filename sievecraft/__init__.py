"""Spark-native engine for near-duplicate grouping, selection and review of media libraries."""

__version__ = "0.1.0"
