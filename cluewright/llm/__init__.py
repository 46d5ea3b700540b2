"""Operators for training-data pipelines, each registered as one query."""
