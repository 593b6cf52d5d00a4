"""Column functions: units, positions, guarded arithmetic."""
