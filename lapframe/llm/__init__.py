"""Training-data operators: deduplication, extraction, scoring, packing and output."""
