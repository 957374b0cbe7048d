"""Readers of formats, and sources of files."""
