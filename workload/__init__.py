"""Queries over the given tables, one per operator, with the SQL that checks each."""
