"""Retrieval analytics over time-ordered frame records, on Spark DataFrames."""
