"""Operators of a training-data pipeline: archives, filters, near-duplicates, search, tokens.

Nothing else in the library imports this subpackage.
"""
