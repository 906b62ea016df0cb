"""Operators for large training corpora, and the queries that apply them."""
