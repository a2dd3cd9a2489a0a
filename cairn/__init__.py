"""Cairn: mountain-pass condition analytics and corpus preparation on PySpark."""
