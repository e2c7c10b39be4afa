"""Structured Streaming forms of the batch transforms."""
