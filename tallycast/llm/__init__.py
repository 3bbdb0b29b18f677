"""Operators for large text corpora: tokens, quality, personal data, duplicates, contamination, archives."""
