"""Training-data operators: sanitising, packing, licence scans, quality, near-duplicates, LM scoring,
fingerprints, line dedup, vector search and source mixing.  Nothing outside this subpackage imports it."""
