"""Markdown compression and corpus analytics on Spark."""
