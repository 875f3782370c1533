"""Queries over the generated tables, with independent SQL for checking."""
