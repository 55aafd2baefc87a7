"""Column expressions and the few vectorized Python functions that built-in ones can't express."""
