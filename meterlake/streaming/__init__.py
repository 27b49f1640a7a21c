"""Structured Streaming forms of ingest, deduplication, spend and alerts."""
