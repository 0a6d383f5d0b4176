"""Streaming of the terrain library."""
