"""Relational operators of the document-text engine."""
