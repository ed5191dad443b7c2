"""Operators of the transit engine, on DataFrames."""
