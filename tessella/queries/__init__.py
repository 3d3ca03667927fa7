"""Queries over the supplied tables, each with the SQL that it must agree with."""
