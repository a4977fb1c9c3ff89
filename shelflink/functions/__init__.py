"""Column expressions: identifiers, titles, similarity, HTML fragments."""
