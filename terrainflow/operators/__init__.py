"""Operators of the terrain library."""
