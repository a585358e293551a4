"""Streaming forms of the sources."""
