"""Retail price and basket analytics on PySpark."""
