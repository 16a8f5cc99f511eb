"""Column expressions: ids, text, vectors and exact ranks."""
