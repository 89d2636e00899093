"""Column-level functions: folds, name similarity, extraction, roster cells, display text."""
