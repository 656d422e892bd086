"""Column functions: types, scalar functions, names and expression text."""
