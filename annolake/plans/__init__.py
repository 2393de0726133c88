"""Queries over the tables of a directory, by name, with the SQL that gives the same rows."""
