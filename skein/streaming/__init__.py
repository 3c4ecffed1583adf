"""Structured Streaming forms of deduplication, outbox draining and windowed counts."""
