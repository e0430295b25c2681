"""Training-data operators: filtering, deduplication, decontamination, tokens, formatting."""
