"""Reading and writing panels and results."""
