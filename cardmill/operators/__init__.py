"""Operators. Each takes DataFrames and gives a DataFrame."""
