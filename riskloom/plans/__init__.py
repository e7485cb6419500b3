"""Query catalogue with DuckDB oracles."""
