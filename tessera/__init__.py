"""Tessera: token-aware text analytics on Spark DataFrames."""
