"""Lexers, grammars and the error-correcting chart parser behind the syntax check."""
