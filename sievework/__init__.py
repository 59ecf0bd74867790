"""Evaluation records, gates and training-text preparation as Spark DataFrames."""
