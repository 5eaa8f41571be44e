"""Where a model would stand: interfaces, and defaults that need none.

An embedder maps texts to vectors, a reranker pairs to scores, a generator prompts to text. The
defaults are deterministic: hashed bags of words, word overlap, and query variants by rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


#: Words up to so many bytes are hashed together, and so many characters of text are at hand at once.
_WORD, _RUN = 64, 1 << 22


def hashes(words: list[str]) -> np.ndarray:
    """:func:`fnv1a` of words without blanks, byte by byte for all of them at once."""
    data = np.frombuffer((" ".join(words) + " ").encode(), dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, _WORD + 1), kind="stable")
    long = int((sizes > _WORD).sum())
    at = starts[order[long:]]
    left = np.bincount(sizes[order[long:]], minlength=_WORD + 1)[::-1].cumsum()[::-1]  # how many have at least so many bytes
    h = np.full(len(at), 2166136261, dtype=np.uint32)
    for k in range(_WORD):
        n = left[k + 1]
        if not n:
            break
        h[:n] = (h[:n] ^ data[at[:n] + k]) * np.uint32(16777619)
    out = np.empty(len(words), dtype=np.uint32)
    out[order[long:]] = h
    for i in order[:long]:
        out[i] = fnv1a(words[i])
    return out


class HashedWords:
    """Unit vectors of word counts by hash."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= _RUN:
                size += len(texts[stop])
                stop += 1
            words = [t.lower().split() for t in texts[start:stop]]
            of = np.repeat(np.arange(stop - start), [len(w) for w in words])
            if len(of):
                at = of * self.dimension + hashes([w for each in words for w in each]) % self.dimension
                out[start:stop] = np.bincount(at, minlength=(stop - start) * self.dimension).reshape(-1, self.dimension)
            start = stop
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "v") -> DataFrame:
    """With a vector column, computed in Arrow batches."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist())))

    return df.withColumn(out, vectors(F.col(text)))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's terms that a text has: the default reranker."""
    terms = T.query_terms(query)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, T.word_set(text))) / F.size(terms))


def expand(query: Column) -> Column:
    """Variants (type, text) of a query: its terms for the words, itself for vectors, and a
    sentence that would answer it."""
    row = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    return F.array(row("lex", F.array_join(F.array_sort(T.query_terms(query)), " ")), row("vec", query), row("hyde", F.concat(F.lit("Information about "), query)))
