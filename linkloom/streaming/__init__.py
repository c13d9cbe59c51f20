"""Streaming of the link index."""
