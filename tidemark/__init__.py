"""Tidemark: epoch and recovery analytics on Spark DataFrames."""
