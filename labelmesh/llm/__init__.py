"""Training-data operators: tokens, chat, packing, mixing, near duplicates, quality, language and toxicity."""
