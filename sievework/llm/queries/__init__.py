"""Queries of the package ``llm``."""
