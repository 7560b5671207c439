"""Operators for training-data pipelines: quality, deduplication, secrets, languages, mixing and packing."""
