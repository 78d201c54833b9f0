"""Every query of the library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from cohortspark.plans import conversation_queries, corpus_queries, evidence_queries, search_queries, stream_queries, text_queries
from cohortspark.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "conversation_queries", "corpus_queries", "evidence_queries", "search_queries", "stream_queries", "text_queries"]
