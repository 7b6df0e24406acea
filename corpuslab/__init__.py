"""Corpus preparation and experiment analytics as Spark DataFrame jobs."""
