"""Structured Streaming wrappers over the batch transforms."""
