"""Catalogue analytics on PySpark."""
