"""Operators of a training-data pipeline: scoring, formatting, tokenising, archives, duplicates, filters.

Nothing outside this package imports it; ``queries.py`` holds the registered queries and their SQL.
"""
