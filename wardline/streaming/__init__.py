"""Structured Streaming versions of the access checks."""
