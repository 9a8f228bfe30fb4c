"""Training-data operators: dedup, filtering, privacy, tokenising and packing of text corpora."""
