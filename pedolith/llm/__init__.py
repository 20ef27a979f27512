"""Training-data operators: deduplication, quality, licences, tokenisation, mixing."""
