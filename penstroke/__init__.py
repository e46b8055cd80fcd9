"""Authorship analysis on Spark DataFrames."""
