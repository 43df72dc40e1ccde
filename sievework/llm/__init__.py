"""Operators for training text and free-typed labels. Nothing outside this package imports it."""
