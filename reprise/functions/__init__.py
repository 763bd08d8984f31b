"""Column functions: text, similarity, quality."""
