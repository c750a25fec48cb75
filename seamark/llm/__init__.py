"""Training-data operators: secrets, near duplicates, media, archives, decontamination, token stores, quality, chat, shards, packing."""
