"""DataFrame-level operators: linkage, misses, grids, merge, enrichment, aggregates, policies."""
