"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import contract_queries, retrieval_queries, store_queries, table_queries

_MODULES = [retrieval_queries, table_queries, contract_queries, store_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
