"""Column-level building blocks (all built-in expressions, no Python UDFs)."""
