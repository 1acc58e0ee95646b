"""Column functions: geometry, rules and texts, all built-in expressions."""
