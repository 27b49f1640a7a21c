"""Operators over usage events: DataFrames in, DataFrames out."""
