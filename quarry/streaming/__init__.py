"""Structured Streaming: index maintenance, seeds, animations."""
