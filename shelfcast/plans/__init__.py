"""Queries and their SQL oracles."""
