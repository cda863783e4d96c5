"""Picking up newly landed files with Structured Streaming."""
