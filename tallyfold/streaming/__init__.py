"""The same rules on file streams."""
