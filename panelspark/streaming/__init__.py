"""Structured Streaming: running regressions, windows, and the catalogue's queue."""
