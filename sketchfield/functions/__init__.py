"""Column expressions: hashes of keys and the bits that they stand for."""
