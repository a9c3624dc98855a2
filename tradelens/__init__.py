"""Marketplace seller analytics and corpus preparation on Spark DataFrames."""
