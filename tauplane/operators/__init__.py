"""Relational operators over score tables."""
