"""Names in texts: one automaton of many names passes over each text once.

The time of a pass depends on the texts and the places found, not on how many names there are. Names go to
tasks in parts of at most ``PART`` of them (their number is counted first), each part scanned for in a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 200_000
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def build(names: list[str]) -> ahocorasick.Automaton | None:
    """An automaton of lower-cased names; null if there is none."""
    found = ahocorasick.Automaton()
    for name in names:
        if name:
            found.add_word(name, name)
    if not len(found):
        return None
    found.make_automaton()
    return found


def names_in(text: str, automaton: ahocorasick.Automaton, boundaries: bool = True) -> list[str]:
    """The names that stand in a lower-cased text; with ``boundaries``, with no ASCII letter or digit right before
    or after them."""
    hits, n = set(), len(text)
    for end, name in automaton.iter(text):
        start = end - len(name)
        if not boundaries or (start < 0 or text[start] not in _ALNUM) and (end + 1 == n or text[end + 1] not in _ALNUM):
            hits.add(name)
    return sorted(hits)


def scan(texts: DataFrame, names: DataFrame, keys: list[str], text: str = "text", part: int = PART, boundaries: bool = True) -> DataFrame:
    """(*keys, name) for each lower-cased name (column ``name``) that stands in a text, at word boundaries or anywhere.

    Null and empty names and texts hold nothing; a text that holds a name often has it once.
    """
    wanted = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
    parts = max(-(-wanted.count() // part), 1)
    kinds = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys)
    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))

    def passed(own: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build(own)
            for batch in batches:
                found = [names_in(t, automaton, boundaries) if t and automaton else [] for t in batch.column("_text").to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], type=pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.array([n for f in found for n in f], type=pa.string())], names=[*keys, "name"])

        return texts.select(*keys, F.lower(text).alias("_text")).mapInArrow(run, f"{kinds}, name string")

    each = [[r["name"] for r in dealt.where(F.col("part") == k).select("name").orderBy("name").collect()] for k in range(parts)]
    return reduce(DataFrame.unionByName, map(passed, each))
