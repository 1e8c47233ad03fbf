"""Operators for preparing training data; ``catalog`` registers one query for each."""
