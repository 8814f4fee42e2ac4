"""Relational operators over sample tables."""
