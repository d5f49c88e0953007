"""Operators for training data: packing, deduplication, search, scoring, encoding and formatting."""
