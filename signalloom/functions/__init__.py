"""Column-level building blocks: guarded statistics and per-entity array expressions."""
