"""Reusable table operators: ranking, joins, sequences, similarity."""
