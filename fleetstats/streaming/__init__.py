"""Batch and stream ingest."""
