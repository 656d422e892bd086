"""Semantic-model analytics on Spark DataFrames."""
