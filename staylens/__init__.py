"""Hybrid search and ranking over review-like text, as Spark plans."""
