"""Adaptive-refinement analytics on Spark DataFrames."""
