"""Training-data operators: dedup, tokenizing, quality, sharding, extraction, scoring, mixing."""
