"""Column functions: words, spans, placeholders, names."""
