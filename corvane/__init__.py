"""Hybrid retrieval over code and documents on Spark: every operator takes and returns DataFrames."""
