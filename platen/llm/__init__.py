"""Operators for large training-data corpora. Nothing outside this folder imports it."""
