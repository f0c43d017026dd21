"""Operators for preparing training data from large text corpora.

Nothing outside this package imports it. ``registry`` names the queries.
"""
