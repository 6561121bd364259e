"""Operators for preparing text corpora: one module each, plus the queries that run them on the given tables."""
