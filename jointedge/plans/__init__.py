"""Queries and their SQL; the feeds and edges register theirs with the others."""

from . import feeds, feeds_sql, edges, edges_sql  # noqa: F401, I001  (the SQL of the edges is made of the others')
