"""Training-data operators: scoring, archives, formatting, search, near-duplicates, extraction, mixing."""
