"""Column expressions: levels, times, fingerprints, formats, text search."""
