"""Column expressions and small table functions on text, identities and concepts."""
