"""Training-data operators: deduplication, language, tokens, secrets, packing, vectors, media and chat."""
