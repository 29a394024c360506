"""Tidemark: a PySpark-native engine for regulatory filings, figures and passages."""

__version__ = "0.1.0"
