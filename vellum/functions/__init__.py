"""Functions of the Markdown engine."""
