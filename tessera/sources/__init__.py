"""Tables, spaces built from them, and generators of invented fields."""
