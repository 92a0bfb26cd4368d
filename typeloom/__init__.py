"""Typed-identifier analytics on PySpark."""
