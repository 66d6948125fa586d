"""Training-data operators: filtering, deduplication, mixing and sharding of text corpora."""
