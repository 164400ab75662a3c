"""Training-data operators: quality, privacy, scoring, mixing, search, deduplication, extraction, archives."""
