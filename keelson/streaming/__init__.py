"""Continuous execution on Structured Streaming."""
