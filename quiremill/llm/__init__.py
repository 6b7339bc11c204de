"""Training-data operators: quality, near-duplicates, language model, search, BPE, packing, media, repeats, id files, secrets."""
