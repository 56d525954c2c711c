"""Operators for preparing language-model training text. Nothing else in the package imports this."""
