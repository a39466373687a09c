"""Column expressions and small Arrow functions."""
