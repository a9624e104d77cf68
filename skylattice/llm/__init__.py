"""Corpus preparation operators: mixing, cleaning, deduplication, classification, encoding, fixity."""
