"""Training-data operators: filters, deduplication, mixing, sharding, formatting and token output."""
