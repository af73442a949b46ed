"""Planning over a dataset's manifest: which stripes a predicate needs, and what metadata alone can answer."""
