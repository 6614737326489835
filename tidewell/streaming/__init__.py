"""Structured Streaming forms of the event rollups."""
