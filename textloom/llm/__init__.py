"""Training-data operators: scoring, selection, search and deduplication over document tables."""
