"""Structured Streaming over price readings."""
