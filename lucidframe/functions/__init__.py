"""Column expressions and small numeric functions that the operators share."""
