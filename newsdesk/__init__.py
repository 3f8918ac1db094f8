"""Operators on editorial content data, as functions from DataFrames to DataFrames."""
