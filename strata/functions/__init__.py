"""Column functions: paths, key/value lists, modes, sizes, names and requests. All are built-in expressions that stay in generated code."""
