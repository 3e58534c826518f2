"""Training-data operators: deduplication, archives, quality, secrets, sharding, decontamination and mixing."""
