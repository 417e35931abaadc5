"""Operators over canonical DataFrames; each is one declarative plan."""
