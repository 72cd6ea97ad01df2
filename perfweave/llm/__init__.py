"""Operators for preparing training text: duplicates, quality, toxicity, leaks, mixing, sharding."""
