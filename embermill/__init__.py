"""Embedding memoisation and retrieval over Spark DataFrames."""
