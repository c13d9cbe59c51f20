"""Functions of the link index."""
