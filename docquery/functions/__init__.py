"""Column functions: text, query understanding, content blocks, vectors."""
