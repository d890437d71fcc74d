"""Column expressions: names and ids, paths, text, vectors and embedding."""
