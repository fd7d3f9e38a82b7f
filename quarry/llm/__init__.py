"""Training-data operators: deduplication, quality, secrets, decontamination, mixing, sharding and scoring."""
