"""Incremental metrics and resumable ingestion on Structured Streaming."""
