"""Structural-quality analytics on Spark DataFrames."""
