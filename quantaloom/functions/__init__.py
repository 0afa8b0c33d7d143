"""Column functions: text composition, record fields, codes and tokens, vectors."""
