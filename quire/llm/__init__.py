"""Training-data operators: decontamination, search, dedup, scoring, packing, extraction, archives."""
