"""Column expressions: n-gram keys, tokenizers and tags."""
