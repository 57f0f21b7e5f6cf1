"""Training-data operators: tokenising, cleaning, deduplicating and scoring text corpora."""
