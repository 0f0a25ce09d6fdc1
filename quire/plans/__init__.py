"""Registered queries and their SQL."""

from quire.plans import corpus_queries, page_queries, search_queries, source_queries, store_queries

_MODULES = (store_queries, search_queries, corpus_queries, source_queries, page_queries)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
