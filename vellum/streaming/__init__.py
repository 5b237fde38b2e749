"""Streaming of the Markdown engine."""
