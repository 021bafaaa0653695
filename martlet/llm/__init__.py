"""Operators for training-data corpora: quality, extraction, deduplication, mixing, tokens and archives."""
