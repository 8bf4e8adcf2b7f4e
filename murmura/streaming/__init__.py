"""Structured Streaming forms of the recording analyses."""
