"""Corpus operators for large-scale training data (self-contained; nothing outside imports this package)."""
