"""Portable analytics re-expressed as Spark jobs."""
