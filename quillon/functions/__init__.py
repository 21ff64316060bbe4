"""Scalar functions, extractors and their registration."""
