"""Structured Streaming counterparts of the incremental jobs."""
