"""Column expressions: hash randomness, vectors, numbers, id patterns and fake values."""
