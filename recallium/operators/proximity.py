"""How near a query's words stand together in a text, and stems of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def min_cover(places: list[list[int]]) -> int | None:
    """The width of the shortest span with a place of every list, None if one is empty."""
    if not places or not all(places):
        return None
    merged = sorted((p, k) for k, own in enumerate(places) for p in own)
    have: dict[int, int] = {}
    best, low = None, 0
    for p, k in merged:
        have[k] = have.get(k, 0) + 1
        while len(have) == len(places):
            q, j = merged[low]
            best = p - q + 1 if best is None else min(best, p - q + 1)
            have[j] -= 1
            if not have[j]:
                del have[j]
            low += 1
    return best


def bucket(words: list[str], terms: list[str]) -> int:
    """0 if the terms stand in a row in their order, 1 if a span of their number and 4 more words
    holds all, else 2. A term stands where a word begins with it."""
    places = [[i for i, w in enumerate(words) if w.startswith(t)] for t in terms]
    if places and all(places):
        sets = [set(p) for p in places]
        if any(all(i + k in s for k, s in enumerate(sets)) for i in places[0]):
            return 0
        if (min_cover(places) or 1 << 30) <= len(terms) + 4:
            return 1
    return 2


def rerank(df: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, words, terms) in a stable order by bucket, then rank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["query_id", "doc_id", "rank"]].assign(bucket=[bucket(list(w), list(t)) for w, t in zip(pdf["words"], pdf["terms"], strict=True)])

    kinds = dict(df.dtypes)
    scored = df.select("query_id", "doc_id", "rank", "words", "terms").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank {kinds['rank']}, bucket long")
    return scored.withColumn("near_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("bucket", "rank", "doc_id")))


_VOWELS = "aeiou"


def stem(word: str) -> str:
    """A light English stemmer: plural, past and progressive endings, then one derivational suffix
    where a syllable is left before it."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for ending in ("ing", "ed"):
        if w.endswith(ending) and any(c in _VOWELS + "y" for c in w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    if w.endswith("y") and any(c in _VOWELS for c in w[:-1]):
        w = w[:-1] + "i"
    for ending, instead in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("tional", "tion"), ("ement", ""), ("ment", ""), ("ness", ""), ("able", ""), ("ible", "")):
        if w.endswith(ending) and any(c in _VOWELS for c in w[: -len(ending)]) and len(w) - len(ending) > 2:
            return w[: -len(ending)] + instead
    return w


def antichain(stems: list[str]) -> list[str]:
    """The distinct stems of which none begins with another."""
    once = list(dict.fromkeys(stems))
    return [s for s in once if not any(o != s and s.startswith(o) for o in once)]
