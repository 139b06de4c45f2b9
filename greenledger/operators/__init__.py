"""Transformations from DataFrames to DataFrames."""
