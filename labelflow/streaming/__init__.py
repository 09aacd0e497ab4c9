"""Incremental ingest and incremental scoring with Structured Streaming."""
