"""Operators for preparing large text and embedding corpora as training data."""
