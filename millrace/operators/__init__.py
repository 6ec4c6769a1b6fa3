"""Operators; each takes DataFrames and explicit key columns and returns a DataFrame."""
