"""Readers: raw trees, folder listings and saved corpora."""
