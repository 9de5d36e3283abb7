"""Readers of documents, configuration and state; schemas are fixed, never inferred."""
