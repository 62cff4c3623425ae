"""Typed-graph integration, search and traversal on Spark DataFrames."""

__version__ = "0.1.0"
