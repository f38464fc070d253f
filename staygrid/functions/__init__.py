"""Column functions: no rows are moved here, everything stays in codegen."""
