"""Operators of a training-data pipeline over tables of documents.

Each module holds one operator; ``queries`` registers them over the test tables.
Nothing outside this package imports it.
"""
