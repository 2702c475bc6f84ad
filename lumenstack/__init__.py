"""Catalog analytics and corpus preparation on PySpark."""
