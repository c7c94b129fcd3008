"""Column expressions: labels, formats, identities."""
