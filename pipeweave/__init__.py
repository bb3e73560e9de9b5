"""Pipelines of named steps over Spark DataFrames."""
