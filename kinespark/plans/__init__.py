"""Expression language: lexer, parser, compiler to Catalyst columns."""
