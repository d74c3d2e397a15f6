"""Training-data operators: deduplication, mixing, scoring, filtering and archives."""
