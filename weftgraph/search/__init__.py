"""Search queries that compile to Column expressions."""
