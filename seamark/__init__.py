"""Retrieval, ranking and evaluation over DataFrames."""
