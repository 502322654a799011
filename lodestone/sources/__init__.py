"""Readers of files and feeds, and writers with upsert semantics."""
