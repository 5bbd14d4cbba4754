"""Operators for preparing training data at scale, with the queries that apply them to the given tables."""
