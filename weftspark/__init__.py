"""Trace analytics, tiled-collection algebra and task graphs as lazy PySpark DataFrames."""
