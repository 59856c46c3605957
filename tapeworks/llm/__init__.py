"""Training-data operators: scoring, filtering, deduplication, masking and packing of text corpora."""
