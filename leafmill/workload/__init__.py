"""Registered checks: the derived `files` view, queries and their SQL."""
