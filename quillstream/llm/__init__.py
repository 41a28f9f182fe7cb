"""Corpus preparation for language-model training: deduplication, filtering, packing and sharding."""
