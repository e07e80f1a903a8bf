"""Operators of a training-data pipeline: deduplication, mixing, scoring, search, rules, tokens."""
