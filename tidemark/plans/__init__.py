"""Queries: what to compute over which tables, with an SQL statement of the same result."""
