"""All queries of the library by name, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from fieldaudit.plans import claim_queries, column_queries, contract_queries, grid_queries, ledger_queries, matrix_queries, model_queries, natural_queries, panel_queries, stats_queries

_MODULES = (panel_queries, column_queries, ledger_queries, stats_queries, model_queries, contract_queries, grid_queries, natural_queries, matrix_queries, claim_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
