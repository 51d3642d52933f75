"""Bounded batches of a load, and view plans over Structured Streaming."""
