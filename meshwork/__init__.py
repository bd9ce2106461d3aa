"""Heterogeneous-information-network analytics on Spark DataFrames."""
