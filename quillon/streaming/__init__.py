"""Incremental forms of the engine's operators."""
