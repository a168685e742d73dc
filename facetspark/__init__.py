"""Facetspark: descriptor analytics for sets of geometric objects, on Spark DataFrames."""
