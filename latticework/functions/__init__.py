"""Column functions of cells."""
