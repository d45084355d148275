"""Operators over DataFrames: asking, combining, deciding."""
