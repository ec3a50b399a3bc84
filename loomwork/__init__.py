"""Loomwork: a PySpark-native engine for matching, cleaning and analysing semi-structured feeds."""

__version__ = "0.1.0"
