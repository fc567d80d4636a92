"""Incremental reports on Structured Streaming."""
