"""Column -> Column expressions. Nothing here starts a Python worker."""
