"""Structured Streaming forms of the graph operators."""
