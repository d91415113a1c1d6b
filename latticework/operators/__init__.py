"""Operators on grids."""
