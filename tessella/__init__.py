"""Chunked multidimensional arrays as Spark DataFrames."""
