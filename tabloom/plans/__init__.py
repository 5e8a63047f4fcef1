"""Tables composed from a declared list of operators and edges."""
