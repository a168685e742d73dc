"""Analytic operators on DataFrames."""
