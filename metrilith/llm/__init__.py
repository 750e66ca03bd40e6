"""Operators for large text corpora: extraction, cleaning, deduplication, scoring and packing."""
