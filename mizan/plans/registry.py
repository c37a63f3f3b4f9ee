"""All registered queries and their SQL."""

from __future__ import annotations

from mizan.plans import lookup_queries, metric_queries, orphan_queries, retrieval_queries, text_queries

FLAGSHIP = "agg1_rrf"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (text_queries, metric_queries, retrieval_queries, lookup_queries, orphan_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
