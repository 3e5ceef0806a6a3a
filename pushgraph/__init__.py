"""Demand-driven pushdown reachability over program-shaped graphs, on Spark DataFrames."""
