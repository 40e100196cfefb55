"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from citeloom.plans import citation_queries, corpus_queries, metric_queries, retrieval_queries, segment_queries, source_queries, tree_queries, verdict_queries

FLAGSHIP = "verbatim_compliance"
_MODULES = (citation_queries, segment_queries, verdict_queries, tree_queries, corpus_queries, retrieval_queries, metric_queries, source_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
