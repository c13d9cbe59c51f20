"""Plans of the link index."""
