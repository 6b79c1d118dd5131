"""Approximate membership and sketch analytics on Spark DataFrames."""
