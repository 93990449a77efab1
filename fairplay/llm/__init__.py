"""Operators of a training-data pipeline: search, extraction, quality, sharding,
language-model scoring, tokenization, mixing, token files and deduplication.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries`` holds the thin registered queries.
"""
