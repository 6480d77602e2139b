"""Registered queries of the vector engine and their SQL."""

from . import source_queries, store_queries, vector_queries

QUERIES = vector_queries.QUERIES | store_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = vector_queries.ORACLE_SQL | store_queries.ORACLE_SQL | source_queries.ORACLE_SQL
