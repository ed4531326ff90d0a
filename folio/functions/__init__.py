"""Column functions (pure expressions over columns)."""
