"""Operators from DataFrames to DataFrames or small models."""
