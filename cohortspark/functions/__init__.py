"""Column functions: scalar helpers and derived clinical measures."""
