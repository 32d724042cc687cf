"""Windowed stream joins on PySpark."""
