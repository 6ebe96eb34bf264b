"""Training-data operators: quality, tokens, decontamination, personal data, mixing, URLs, near and exact copies."""
