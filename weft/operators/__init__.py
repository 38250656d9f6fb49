"""Operators that Spark composes from DataFrames: two-stage aggregates, states, windows, governance."""
