"""Operators of the link index."""
