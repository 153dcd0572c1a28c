"""Operators for text and training data. Nothing outside this package imports it."""
