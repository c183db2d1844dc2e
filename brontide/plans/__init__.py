"""Queries by family."""

from __future__ import annotations

from . import corpus_queries, evidence_queries, model_queries, observation_queries, verification_queries

FAMILIES = (observation_queries, verification_queries, evidence_queries, corpus_queries, model_queries)


def all_queries() -> dict:
    return {n: q for f in FAMILIES for n, q in f.R.queries.items()}


def all_sql() -> dict[str, str]:
    return {n: q for f in FAMILIES for n, q in f.R.sql.items()}
