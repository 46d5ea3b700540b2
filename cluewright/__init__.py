"""Investigative analytics as Spark jobs."""
