"""Operators put together over the given tables, with the SQL they must agree with."""
