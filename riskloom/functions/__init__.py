"""Column expressions: no state, no shuffles."""
