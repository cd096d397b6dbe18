"""Column functions on words, times and keys."""
