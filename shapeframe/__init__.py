"""Nested views over flat tables, planned as Spark DataFrames."""
