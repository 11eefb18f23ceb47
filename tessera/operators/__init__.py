"""Running statements: the database handle, decoding, builders, relationships and writes."""
