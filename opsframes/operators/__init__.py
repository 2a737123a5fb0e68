"""The queries: plain functions from DataFrames (and parameters) to DataFrames."""
