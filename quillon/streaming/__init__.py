"""Structured Streaming forms of ingestion, deduplication and dwell tracking."""
