"""Greedy diversity over a query's few results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _similarity(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr_order(sets: list[frozenset], limit: float) -> list[int]:
    """Selected items in order, then those too much like a selected one; none is dropped."""
    if len(sets) <= 2:
        return list(range(len(sets)))
    selected, deferred = [], []
    for i, s in enumerate(sets):
        (deferred if any(_similarity(s, sets[j]) > limit for j in selected) else selected).append(i)
    return selected + deferred


def mmr(df: DataFrame, limit: float = 0.6) -> DataFrame:
    """Reorder (query_id, doc_id, rank, shingles): (query_id, doc_id, rank, diverse_rank). A query
    has as many rows as its list is long, some tens."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        at = mmr_order([frozenset(x) for x in pdf["shingles"]], limit)
        out = pdf.iloc[at][["query_id", "doc_id", "rank"]].copy()
        out["diverse_rank"] = range(len(out))
        return out

    kinds = dict(df.dtypes)
    return df.groupBy("query_id").applyInPandas(order, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank int, diverse_rank long")


