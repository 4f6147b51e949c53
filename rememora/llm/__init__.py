"""Training-data operators: fingerprints, filters, packing, tokenizers, archives, extraction."""
