"""Relational operators, each a DataFrame -> DataFrame function."""
