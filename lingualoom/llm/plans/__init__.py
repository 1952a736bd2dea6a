"""Queries over the text operators."""
