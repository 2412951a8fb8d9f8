"""Training-data operators: scoring, dedup, tokenisation, filtering."""
