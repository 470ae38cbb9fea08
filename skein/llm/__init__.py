"""Corpus operators for large training-data pipelines."""
