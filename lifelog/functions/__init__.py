"""Column functions: durations, labels, slugs, map geometry, death verdicts."""
