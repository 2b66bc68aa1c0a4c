"""Registered queries: each operator on the star-schema tables, with the same query in SQL."""
