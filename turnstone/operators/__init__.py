"""Operators of the engine, as DataFrame transforms."""
