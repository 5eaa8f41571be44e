"""Scores of memories: decay with age, confidence, quality, length and their composite."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a memory of a type counts half; the types without end last.
HALF_LIVES = {"handoff": 30, "progress": 45, "conversation": 45, "problem": 60, "milestone": 60, "note": 60, "research": 90, "project": 120, "decision": 180}
ENDLESS = ["preference", "deductive", "hub", "antipattern"]
UNKNOWN_HALF_LIFE = 60
#: Confidence in a fresh memory of a type.
BASELINES = {
    "decision": 0.85, "deductive": 0.85, "preference": 0.80, "hub": 0.80, "antipattern": 0.75, "problem": 0.75, "research": 0.70,
    "milestone": 0.70, "project": 0.65, "handoff": 0.60, "conversation": 0.55, "progress": 0.50, "note": 0.50,
}
#: Types whose confidence doesn't fade without attention.
ATTENDED = ["decision", "deductive", "preference", "hub", "research", "antipattern"]
#: Search, recency and confidence weights of the composite.
WEIGHTS = {"default": (0.5, 0.25, 0.25), "recency": (0.1, 0.7, 0.2), "query": (0.7, 0.15, 0.15)}


def _lookup(kind: Column, values: dict, default) -> Column:
    found = F.lit(float(default))
    for k, v in values.items():
        found = F.when(kind == k, float(v)).otherwise(found)
    return found


def half_life(kind: Column) -> Column:
    """Days; null for types without end."""
    return F.when(~kind.isin(ENDLESS), _lookup(kind, HALF_LIVES, UNKNOWN_HALF_LIFE))


def effective_half_life(kind: Column, accesses: Column, days_since_access: Column) -> Column:
    """Fresh accesses lengthen it, up to three times."""
    fresh = F.greatest(F.lit(0.0), 1 - days_since_access / 90)
    return F.least(half_life(kind) * (1 + 0.3 * F.log1p(accesses * fresh)), half_life(kind) * 3)


def recency(days: Column, life: Column) -> Column:
    """0.5 to the power of age over half-life; 1 for the future and for types without end, 0.5
    without a date."""
    return F.when(days.isNull(), 0.5).when(life.isNull() | (days <= 0), 1.0).otherwise(F.pow(F.lit(0.5), days / life))


def confidence(kind: Column, days: Column, life: Column, accesses: Column, days_since_access: Column) -> Column:
    """Baseline, faded by age, raised by accesses, lowered without attention."""
    raised = F.least(F.lit(1.5), 1 + 0.1 * F.log2(1 + accesses.cast("double")))
    attention = F.when(kind.isin(ATTENDED) | days_since_access.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.pow(F.lit(0.95), days_since_access / 7)))
    return F.least(F.lit(1.0), _lookup(kind, BASELINES, 0.5) * recency(days, life) * raised * attention)


def stored_blend(stored: Column, computed: Column) -> Column:
    """Half of the computed confidence follows the stored one, unless that is the default."""
    return F.when(stored == 0.5, computed).otherwise(F.least(F.lit(1.0), computed * (stored / 0.5) * 0.5 + computed * 0.5))


def quality_factor(quality: Column) -> Column:
    return 0.7 + 0.6 * quality


def length_factor(length: Column) -> Column:
    """Texts beyond 500 characters count less, not under 0.3."""
    return F.greatest(F.lit(0.3), 1 / (1 + 0.5 * F.log2(F.greatest(length / 500, F.lit(1.0)))))


def frequency_factor(revisions: Column, duplicates: Column) -> Column:
    return 1 + F.least(F.lit(0.1), 0.03 * F.log1p((2 * (revisions - 1) + (duplicates - 1)).cast("double")))


def composite(search: Column, recent: Column, sure: Column, weights: str = "default") -> Column:
    """Weighted sum; what isn't finite counts 0."""
    w = WEIGHTS[weights]
    fine = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == math.inf), 0.0).otherwise(c)
    return fine(search) * w[0] + fine(recent) * w[1] + fine(sure) * w[2]


def pinned(score: Column, pin: Column) -> Column:
    return F.when(pin, F.least(F.lit(1.0), score + 0.3)).otherwise(score)


def diversity(queries: Column, days: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(queries, days) / 5)


def spacing(days: Column, span_days: Column) -> Column:
    """How well recalls are spread over days: 0 without, 0.2 on one day."""
    many = 0.55 * F.least(F.lit(1.0), F.log1p((days - 1).cast("double")) / math.log1p(4)) + 0.45 * F.least(F.lit(1.0), span_days / 7)
    return F.when(days == 0, 0.0).when(days == 1, 0.2).otherwise(many)


def memory_type(kind: Column) -> Column:
    """Episodic, semantic or procedural."""
    return F.when(kind.isin("handoff", "conversation", "progress"), "episodic").when(kind.isin("antipattern"), "procedural").otherwise("semantic")


def tier(score: Column) -> Column:
    """How much of a result is shown."""
    return F.when(score > 0.8, "HOT").when(score > 0.6, "WARM").otherwise("COLD")
