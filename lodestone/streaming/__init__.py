"""Structured Streaming: feeds, windows, sessions and incremental extraction."""
