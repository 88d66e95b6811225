"""Structured Streaming versions of keyed screens."""
