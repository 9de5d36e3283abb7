"""Scalar expressions on columns; all of them run in the JVM."""
