"""Relational operators over content tables: DataFrames in, DataFrames out."""
