"""Operators: each takes DataFrames plus column names and thresholds, and returns DataFrames."""
