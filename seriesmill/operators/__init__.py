"""Operators on series and samples: DataFrames in, DataFrames out."""
