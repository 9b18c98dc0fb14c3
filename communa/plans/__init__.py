"""Driver loops that chain operators into whole algorithms."""
