"""Corpus operators for training data: filters, dedup, scans, tokenizers and search."""
