"""Whole pipelines made of operators, and the registry of named queries."""
