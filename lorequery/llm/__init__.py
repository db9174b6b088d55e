"""Operators of a training-data pipeline: search, filtering, deduplication, redaction and packing."""
