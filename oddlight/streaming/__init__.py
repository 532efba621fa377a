"""Incremental fits over Structured Streaming."""
