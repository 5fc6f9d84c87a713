"""Operators on tables: each takes and returns DataFrames."""
