"""Operators of a training-data pipeline: scoring, filtering, deduplication, tokenisation.

Nothing outside this subpackage imports it.
"""
