"""Source corpus derived from the given tables, and the registered queries over it."""
