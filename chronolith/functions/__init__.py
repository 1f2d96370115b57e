"""Column functions and the lexer."""
