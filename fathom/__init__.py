"""Relational code-graph and corpus analysis on Spark DataFrames."""
