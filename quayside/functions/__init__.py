"""Column functions. Everything here is a built-in expression and stays in generated code."""
