"""Column functions: vectors and reproducible random order."""
