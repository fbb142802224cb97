"""Column expressions and the statistics shared by several operators."""
