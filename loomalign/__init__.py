"""Sequence-alignment search and corpus analytics on Spark DataFrames."""
