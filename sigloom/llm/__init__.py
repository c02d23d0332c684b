"""Operators of a large-scale training-data pipeline, each taking and returning DataFrames."""
