"""Column functions: names, headers, decoding, tokens, ranking and snippets."""
