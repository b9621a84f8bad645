"""Column functions: bit keys, signatures, quality scales, gates."""
