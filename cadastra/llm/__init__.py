"""Operators of a training-data pipeline over text, conversations and vectors.

Nothing outside this package imports it.
"""
