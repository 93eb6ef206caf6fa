"""Training-data operators: tokenising, filtering, deduplication, packing and chat formatting on Spark."""
