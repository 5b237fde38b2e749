"""Sources of the Markdown engine."""
