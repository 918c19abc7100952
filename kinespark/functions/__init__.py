"""Column builders: element-wise functions, aggregates, vectors."""
