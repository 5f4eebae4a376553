"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames, selects the columns it needs first (so further columns, whatever
their names, never clash with its own) and returns a DataFrame.
"""
