"""Column functions: names, scores, statistics."""
