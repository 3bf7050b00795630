"""Runnel: ordered-series analytics on PySpark (package root)."""
