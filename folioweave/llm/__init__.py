"""Operators for building training data: name variants, clusters, co-occurrence, answer defects, splitting, neighbours, tokens, mixtures, quality."""
