"""Training-data operators on Spark (dedup, sharding, filtering, packing, search)."""
