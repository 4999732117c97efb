"""Column expressions: text, vectors and scores."""
