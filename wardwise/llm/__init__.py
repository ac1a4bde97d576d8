"""Training-data pipeline operators: text scoring, tokenizing, deduplication, archives, search."""
