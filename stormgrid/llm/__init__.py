"""Operators of a training-data pipeline: cleaning, deduplication, scoring and packing of texts."""
