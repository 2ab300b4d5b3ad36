"""Operators for large-scale text and embedding corpora; nothing outside this subpackage imports it."""
