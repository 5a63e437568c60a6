"""Operators on tables and on models of tables: DataFrames in, DataFrames out."""
