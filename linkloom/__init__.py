"""Reverse-link analytics on Spark."""
