"""Reading, loading and deriving the logical tables."""
