"""Operators for large text corpora: fingerprints, chat formatting, URL filters, near-duplicates, language
identification, packing, quality rules, byte-level BPE, line dedup and sanitisation of personal data."""
