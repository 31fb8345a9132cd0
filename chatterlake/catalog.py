"""Every query by name, with the SQL statement that it is held against where there is one."""

from __future__ import annotations

from .plans import mention_queries, relational_queries, report_queries, streaming_queries

MODULES = (report_queries, mention_queries, relational_queries, streaming_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
