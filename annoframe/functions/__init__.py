"""Column expressions: fixed vocabularies, hashed draws, sequence and feature expressions."""
