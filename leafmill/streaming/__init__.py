"""Structured Streaming over files."""
