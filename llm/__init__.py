"""Operators for preparing training text: filters, deduplication, search, mixing, packing, formatting."""
