"""Column helpers and generic distributed building blocks."""
