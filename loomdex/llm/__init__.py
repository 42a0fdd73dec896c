"""Training-data operators: scoring, filtering, deduplication, auditing and tokenisation."""
