"""Operators for training corpora, their queries and SQL; nothing else in the library imports this package."""
