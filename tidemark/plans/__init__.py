"""Queries over the standard tables, each with the SQL that gives the same rows."""
