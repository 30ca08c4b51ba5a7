"""Operators for large text corpora: deduplication, tokenised output, language
identification, private data, packing, quality, toxicity, decontamination and
secrets. Nothing outside this package imports it."""
