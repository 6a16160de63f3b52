"""Operators for preparing training data: token output, search, mixing, deduplication, filters.

Nothing else in the library imports this subpackage.
"""
