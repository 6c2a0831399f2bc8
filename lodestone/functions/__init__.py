"""Column-level functions: text, vectors, hashing, paths."""
