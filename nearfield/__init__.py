"""Filtered nearest-neighbour search over Spark DataFrames."""
