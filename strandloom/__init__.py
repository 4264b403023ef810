"""Sequence-motif analytics on Spark DataFrames."""
