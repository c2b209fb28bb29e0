"""Queries over the given tables, each with the SQL that states its expected result."""
