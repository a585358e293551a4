"""Tessera: concept-graph analytics on Spark DataFrames."""
