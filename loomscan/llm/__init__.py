"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Every operator takes DataFrames and
column names, and selects only the columns it needs, so further columns of the input,
whatever their names, don't matter.
"""
