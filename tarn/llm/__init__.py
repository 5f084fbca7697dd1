"""Operators for large training-text corpora: deduplication, classifiers, extraction, packing.

Nothing else in the package imports this subpackage; ``queries`` holds the
registered queries and ``sql`` their oracle SQL.
"""
