"""Operators for training-data pipelines: deduplication, filters, tokenising, search."""
