"""Structured Streaming forms of the polling loops."""
