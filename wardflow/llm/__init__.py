"""Training-data operators: quality, mixing, deduplication, tokens, secrets, personal data, search and sharding."""
