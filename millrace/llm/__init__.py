"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin query
of each operator and ``oracles.py`` the SQL that checks them.
"""
