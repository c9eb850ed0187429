"""Structured Streaming jobs (incremental facet refresh)."""
