"""Operators for text and training-data pipelines.  Nothing outside this package imports it."""
