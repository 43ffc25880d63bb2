"""Operators over DataFrames; each takes and returns lazy frames."""
