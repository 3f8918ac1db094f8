"""Operators: functions from DataFrames to a DataFrame.  Every order has an explicit last key, so that ties are settled."""
