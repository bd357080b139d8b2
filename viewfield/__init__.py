"""Terrain visibility and sensor coverage on Spark: tables in, tables out."""
