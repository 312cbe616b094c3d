"""Operators for preparing training text: deduplication, filters, archives, tokenization."""
