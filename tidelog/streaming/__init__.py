"""Structured Streaming on the log."""
