"""Registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

from sieveline.plans import eval_queries, history_queries, io_queries, profile_queries, retrieval_queries, text_queries

MODULES = [text_queries, retrieval_queries, history_queries, eval_queries, profile_queries, io_queries]


def _all() -> dict:
    return {name: pair for m in MODULES for name, pair in m.QUERIES.items()}


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark, sf_dir):
    return _all()["bm25_global_topk"][0](spark, sf_dir)
