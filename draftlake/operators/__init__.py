"""Relational operators on drawing records: DataFrames in, DataFrames out."""
