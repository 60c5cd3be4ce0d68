"""Weighted survey analytics and multilevel variance decomposition on Spark DataFrames."""

__version__ = "0.1.0"
