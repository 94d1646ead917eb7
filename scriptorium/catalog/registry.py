"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from scriptorium.catalog import query_queries, table_queries, text_queries

_MODULES = (text_queries, table_queries, query_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
flagship = query_queries.flagship
