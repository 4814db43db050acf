"""DataFrame operators that read source facts out of source text."""
