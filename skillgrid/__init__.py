"""Gridded forecast verification and corpus preparation on Spark DataFrames."""
