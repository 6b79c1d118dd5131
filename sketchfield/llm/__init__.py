"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin registered queries over them.
"""
