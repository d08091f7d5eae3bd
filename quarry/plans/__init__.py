"""Queries by name, and analyses of SQL statements and execution plans."""
