"""Operators on plain DataFrames; tidemark.timed puts them on frames with epochs."""
