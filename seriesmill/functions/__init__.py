"""Column functions on label sets."""
