"""Relational operators of the engine."""
