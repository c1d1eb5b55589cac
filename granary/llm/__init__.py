"""Training-data operators: deduplication, quality, mixing, packing and formatting."""
