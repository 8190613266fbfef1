"""Operators for training-data pipelines: extraction, scoring, deduplication, packing."""
