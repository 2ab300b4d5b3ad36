"""Relational operators of the event domain: DataFrame in, DataFrame out."""
