"""Queries over the test tables, and SQL texts with the same results."""
