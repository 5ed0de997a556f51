"""Cohort variant annotation and querying on Spark DataFrames."""
