"""Training-data operators: quality, dedup, decontamination, packing and more."""
