"""Training-data operators: scoring, mixing, deduplication, token counts, extraction, search, packing, scans."""
