"""Operators that prepare training text: filters, deduplication, mixing and sharding."""
