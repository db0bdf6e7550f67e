"""Readers: configuration lists, landed tables, local files."""
