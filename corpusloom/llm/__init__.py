"""Operators that prepare training text: deduplication, quality, filters, extraction, mixing and packing."""
