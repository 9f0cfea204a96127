"""DataFrame operators: every column name and window is a parameter."""
