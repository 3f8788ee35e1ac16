"""Column expressions; all are built-in functions that stay in generated code."""
