"""Operators for preparing text corpora; see README. Nothing else in the library imports this."""
