"""Epoch-stamped analytics on Spark DataFrames."""
