"""Registered queries of the retrieval operators and their SQL counterparts."""

from __future__ import annotations

from . import chunk_queries, evidence_queries, graph_queries, ingest_queries, lease_queries, ledger_queries, operation_queries, resolution_queries, search_queries, text_search_queries

QUERIES, ORACLES = {}, {}
for part in (search_queries, ingest_queries, graph_queries, operation_queries, evidence_queries, resolution_queries, text_search_queries, ledger_queries, chunk_queries, lease_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
