"""Column expressions, and the numerical functions that columns can't express."""
