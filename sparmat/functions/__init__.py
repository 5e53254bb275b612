"""Column expressions: scalars that stay inside whole-stage code generation."""
