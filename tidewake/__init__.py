"""Vessel-movement analytics on PySpark."""
