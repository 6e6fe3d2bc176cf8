"""Registered queries over the standard tables, and their DuckDB SQL."""

from __future__ import annotations

from tramline.plans import history, network, shrinkage, stats, tables, tables_sql

flagship = network.flagship

_PARTS = (network, history, stats, shrinkage, tables)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: history.off_edge(sql) for part in (*_PARTS, tables_sql) for name, sql in part.ORACLE_SQL.items()}
