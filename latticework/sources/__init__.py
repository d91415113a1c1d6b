"""Files of grids: readers and writers."""
