"""Column functions: text, vectors and small scalars."""
