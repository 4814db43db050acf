"""Column-level helpers: text clean-up, source outlines and type-text rules."""
