"""Plans of the terrain library."""
