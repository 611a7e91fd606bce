"""Hybrid retrieval and web-archive analytics on DataFrames."""
