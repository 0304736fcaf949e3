"""Training-data operators: decontamination, scoring, encoding, deduplication, search and formatting."""
