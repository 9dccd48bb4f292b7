"""Operators for large-scale training-data preparation.

Every operator is a function from DataFrames to DataFrames. Nothing outside
this subpackage imports it.
"""
