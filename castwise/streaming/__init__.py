"""Incremental versions of the summaries."""
