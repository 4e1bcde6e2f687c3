"""Registered queries of the relational operators and their SQL."""

from __future__ import annotations

from . import content_queries, corpus_queries, crawl_queries, evidence_queries, mention_queries, network_queries, page_queries, source_queries

MODULES = (mention_queries, page_queries, evidence_queries, network_queries, corpus_queries, crawl_queries, content_queries, source_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "gate_reasons"
