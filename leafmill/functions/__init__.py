"""Column functions: text, identifiers, geometry, hashes and codes."""
