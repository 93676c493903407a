"""Spatial aggregation of points over polygons, as Spark plans."""
