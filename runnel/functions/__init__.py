"""Runnel: ordered-series analytics on PySpark (functions)."""
