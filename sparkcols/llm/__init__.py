"""Operators of a training-data pipeline: filters, near duplicates, search, mixing, tokens, secrets, pages."""
