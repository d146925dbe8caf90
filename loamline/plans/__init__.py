"""Whole flows: building a version, publishing it, resolving, searching and reading."""
