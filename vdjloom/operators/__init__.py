"""Operators on reads; each takes and returns DataFrames."""
