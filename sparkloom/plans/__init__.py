"""Whole query plans and the registry of queries."""
