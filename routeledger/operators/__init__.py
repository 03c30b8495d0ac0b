"""Operators: every stage maps DataFrames to DataFrames."""
