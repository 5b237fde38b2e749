"""Operators of the Markdown engine."""
