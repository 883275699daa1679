"""Column functions: paths, labels, formats, vectors, chunks."""
