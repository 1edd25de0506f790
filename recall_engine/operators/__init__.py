"""Relational operators on catalogue, index and log tables."""
