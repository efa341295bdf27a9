"""Column helpers: built-in expressions only, no Python runs per row."""
