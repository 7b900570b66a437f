"""Column functions and text."""
