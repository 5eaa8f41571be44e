"""Contradictions, merge safety and contamination by rules; a model may refine them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import CAPITALISED, PROPER_NOUN, distinct_words


def contradiction(a: Column, b: Column) -> Column:
    """0.6 if one text negates and the other doesn't, 0.5 if both state numbers and share none."""
    x, y = T.numbers(a), T.numbers(b)
    apart = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    return F.when(T.negated(a) != T.negated(b), 0.6).when(apart, 0.5).otherwise(0.0)


def trigram_counts(text: Column) -> Column:
    """Maps of three characters to counts of a collapsed text."""
    t = T.collapsed(text)
    n = F.greatest(F.length(t) - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(3)))


def anchors(text: Column) -> Column:
    """Capitalised words that aren't stopwords, lower-cased."""
    words = F.array_distinct(F.transform(distinct_words(text, CAPITALISED), F.lower))
    return F.filter(words, lambda w: ~w.isin(T.NOT_NAMES))


def diverging(a: Column, b: Column) -> Column:
    """Whether anchors tell two texts apart: not if one set holds the other; yes if they are
    disjoint, or share at most half of the smaller."""
    both = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when((least == 0) | (both == least), False).when(both == 0, True).otherwise(both / least <= 0.5)


def safe_merge(similarity: Column, a: Column, b: Column) -> Column:
    """Whether two texts may be merged: 0.93 alike where anchors agree, never if they diverge,
    0.98 where there are none."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, similarity >= 0.98).when(diverging(a, b), False).otherwise(similarity >= 0.93)


def contaminated(conclusion: Column, evidence: Column) -> Column:
    """Names in a conclusion that its evidence doesn't hold."""
    return F.array_except(distinct_words(conclusion, PROPER_NOUN), distinct_words(evidence, PROPER_NOUN))


def outcome(relation: Column, confidence: Column, before: Column) -> Column:
    """Confidence after a judged relation of 0.7 or more: -0.25 but not under 0.2 for a
    contradiction, -0.15 but not under 0.3 for an update."""
    sure = confidence >= 0.7
    return F.when(sure & (relation == "contradiction"), F.greatest(F.lit(0.2), before - 0.25)).when(sure & (relation == "update"), F.greatest(F.lit(0.3), before - 0.15)).otherwise(before)
