"""Column expressions: text, scores, vectors."""
