"""Hierarchical-matrix analytics on Spark DataFrames."""
