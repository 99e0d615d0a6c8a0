"""Corpus operators: cleaning, deduplication, mixing, sharding, tokens, scores."""
