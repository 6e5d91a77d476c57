"""Column functions: time keys, names, casts, texts."""
