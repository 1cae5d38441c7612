"""Registered queries over the given tables, each with SQL that says the same."""
