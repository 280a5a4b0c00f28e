"""Operators of a training-data pipeline.

Each module holds one operator with a general interface and the query registered for it.
Nothing outside this package imports it.
"""
