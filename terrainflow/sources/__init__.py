"""Sources of the terrain library."""
