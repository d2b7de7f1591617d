"""Operators for training-data pipelines: filters, deduplication, mixing, scoring, packing."""
