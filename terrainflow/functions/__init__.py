"""Functions of the terrain library."""
