"""Column expressions: text in, counts, ratios and request parts out."""
