"""Audit rules, each a function from DataFrames to a DataFrame."""
