"""Numeric, graph and scaling-study jobs on Spark DataFrames."""
