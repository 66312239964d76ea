"""Relational operators of the panel engine."""
