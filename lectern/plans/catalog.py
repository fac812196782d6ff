"""The registered queries of the reading-library operators and the SQL that checks them."""

from __future__ import annotations

from lectern.plans import blocks, corpus, devices, exchange, language, library, live, statistics

_PARTS = (statistics, library, corpus, language, devices, blocks, exchange, live)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
