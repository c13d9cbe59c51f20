"""Sources of the link index."""
