"""Operators of a training-data pipeline: filters, deduplication, tokens, mixing, archives."""
