"""Sequence analytics on Spark DataFrames: k-mers, overlaps, assembly, profiles and search."""
