"""Operators of the resolution pipeline, DataFrames in and out."""
