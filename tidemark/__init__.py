"""Tidemark: point-in-time forecasting analytics on Spark DataFrames."""
