"""Documents over time: eligibility, staleness, mutation, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as Time
from .fold import fold_sorted


def eligible(allowed: list[str] | None = None, denied: list[str] | None = None, first=None, last=None) -> Column:
    """Active, valid, in the collections and time range asked for."""
    ok = F.col("active") & ~F.col("invalidated")
    if allowed:
        ok = ok & F.col("collection").isin(allowed)
    if denied:
        ok = ok & ~F.col("collection").isin(denied)
    if first is not None:
        ok = ok & (F.col("modified_at") >= F.lit(first).cast("timestamp"))
    if last is not None:
        ok = ok & (F.col("modified_at") <= F.lit(last).cast("timestamp"))
    return ok


def archive_candidates(docs: DataFrame, now: str, days: int, by_type: dict[str, int | None]) -> DataFrame:
    """Active, unpinned documents older than their type's limit both since the last change and
    the last access; types with no limit are exempt, without access only the change counts."""
    limit = F.lit(days)
    for kind, d in by_type.items():
        limit = F.when(F.col("content_type") == kind, F.lit(d)).otherwise(limit)
    old = lambda c: F.coalesce(Time.age_days(F.col(c), now) > limit, F.lit(True))
    return docs.where(F.col("active") & ~F.col("pinned") & limit.isNotNull() & old("modified_at") & old("last_accessed_at"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with equal keys. (A join with MERGE's result:
    the newest row of each key.)"""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))).where("_n = 1").drop("_new", "_n")


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` where they aren't null."""
    named = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    joined = old.join(named, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else c for c in old.columns))


def new_contents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contents whose hash isn't stored yet, each once."""
    return incoming.dropDuplicates(["hash"]).join(stored, "hash", "left_anti")


def fixed_windows(saves: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Saves (id, at in seconds, keys) with the save that each counts as a repetition of: windows
    begin at the first save that the window before doesn't cover."""

    def step(state, row):
        if state is None or row.at - state[0] >= seconds:
            state = (row.at, row.id)
        return state, (state[1],)

    return fold_sorted(saves.select("id", "at", *keys), keys, ["at", "id"], step, "survivor long")


def sliding_windows(seen: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Sightings with whether they repeat one less than so many seconds before."""
    last = F.lag(F.unix_timestamp(at)).over(Window.partitionBy(*keys).orderBy(at, "id"))
    return seen.withColumn("duplicate", F.coalesce(F.unix_timestamp(at) - last < seconds, F.lit(False)))


def copies(docs: DataFrame) -> DataFrame:
    """Groups of documents with the same text up to case and white space."""
    return docs.groupBy(T.normalized_hash(F.col("body")).alias("normalized_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def trend(proofs: Column, age_days: Column, since_days: Column) -> Column:
    """How an observation develops by its age, its last change and its proofs."""
    return F.when(age_days < 7, "NEW").when(since_days > 60, "STALE").when(since_days > 30, "WEAKENING").when((proofs >= 4) & (since_days < 14), "STRENGTHENING").otherwise("STABLE")


def erosion(events: DataFrame, key: str, order: list[str], relation: str, start: float) -> DataFrame:
    """Confidence after each of a sequence of contradictions (-0.25, not under 0.2) and updates
    (-0.15, not under 0.3), whose order matters."""

    def step(state, row):
        c = start if state is None else state
        what = getattr(row, relation)
        c = max(0.2, c - 0.25) if what == "contradiction" else max(0.3, c - 0.15) if what == "update" else c
        return c, (c,)

    return fold_sorted(events.select(key, *order, relation), [key], order, step, "confidence double")
