"""Operators on text corpora: deduplication, scoring, mixing, archives and tokens."""
