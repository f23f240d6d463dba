"""Operators of a training-data pipeline: filters, scores, near-duplicates, encoders.

Nothing outside this subpackage imports it; `queries.py` binds the operators to
the tables.
"""
