"""Operators on relations by instant: DataFrames with a _TS column."""
