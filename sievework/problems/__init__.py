"""The training-data queries of the core; each applies one operator to its whole tables."""
