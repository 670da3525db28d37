"""Column functions: no Python code runs per row."""
