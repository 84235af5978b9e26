"""Schemas, readers and stored tables."""
