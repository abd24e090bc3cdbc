"""Column functions: exact integer ratios, identities, bit operations, text and colour helpers."""
