"""Readers, the staging mapping, written tables, and views over the given tables."""
