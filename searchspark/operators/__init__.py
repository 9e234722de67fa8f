"""Operators on DataFrames: intake, gate, index, vectors, search."""
