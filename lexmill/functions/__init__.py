"""Column-level functions: text, tokens, n-grams, hashing."""
