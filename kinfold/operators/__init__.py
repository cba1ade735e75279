"""Relational operators of record linkage; pure functions from DataFrames to DataFrames."""
