"""Readers, landed payloads and writers."""
