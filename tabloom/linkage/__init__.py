"""Record linkage between a left and a right table."""
