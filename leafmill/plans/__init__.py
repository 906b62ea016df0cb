"""Composed jobs: raw trees or converted trees to written corpora."""
