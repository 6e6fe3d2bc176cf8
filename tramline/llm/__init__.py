"""Operators of a training-data pipeline: token files, classifiers, deduplication, mixing and extraction.

Nothing outside this folder imports it.  Every operator is a function from DataFrames to DataFrames;
``queries.py`` holds the registered queries and their SQL.
"""
