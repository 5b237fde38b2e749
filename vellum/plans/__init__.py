"""Plans of the Markdown engine."""
