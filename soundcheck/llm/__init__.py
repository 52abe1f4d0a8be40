"""Operators of a training-data pipeline over documents, embeddings and conversations.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; ``queries.py`` applies each to its whole table.
"""
