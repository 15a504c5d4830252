"""Operators of a training-data pipeline: deduplication, mixing, scoring, filtering, media and packing."""
