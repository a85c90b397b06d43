"""Masking in Structured Streaming."""
