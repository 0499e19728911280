"""Relational operators over block and chunk tables."""
