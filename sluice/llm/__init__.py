"""Training-data operators: quality, dedup, fingerprints, mixing, PII, toxicity, BPE, search, language."""
