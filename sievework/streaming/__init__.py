"""Structured Streaming: refresh of the registry, event windows."""
