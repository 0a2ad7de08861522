"""Training-data operators: dedup, packing, filtering, mixing, search and formatting."""
