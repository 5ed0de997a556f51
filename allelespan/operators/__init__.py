"""Operators: functions from DataFrames to a DataFrame. None of them collects its result."""
