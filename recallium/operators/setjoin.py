"""Pairs of similar sets of words, counted chunk by chunk.

Sets with a Jaccard index above t have sizes within a factor t, so sets are dealt to chunks by size and only chunks of near
sizes meet. A chunk holds which of its sets have a word, by the word's 64-bit hash (two words of one hash would count as one, two sets of one hash too).
For two chunks one matrix product gives in how many of a few hundred bits the sketches of all their pairs differ. A word changes one bit, so sets that differ in more bits than similar
ones may in words are left out, and none that is similar; words are counted in the pairs that stay. Where many stay (groups of near copies), shared words are counted for all pairs of the chunks
at once: frequent words by a matrix product, others pair by pair. Chunks are read where they meet, and only similar pairs leave a task, so what is shuffled grows with the rows and not with their pairs. Equal sets are one
row until the end, so copies don't meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import few, written

#: Words and sets that a chunk holds at most (one larger set is a chunk of its own), and how much sizes differ in it.
CHUNK_WORDS, CHUNK_SETS, STEP = 1 << 20, 4096, 1.2
#: Chunks in a file: those of one file of each side meet in a task.
FILE_CHUNKS = 8
#: A word that at least this many pairs of sets share is counted by the matrix product.
FREQUENT = 20_000
_PAIRS = 1 << 21
#: Bits of a sketch: at least so many, and so many for each word in which similar sets may differ.
LEAST_BITS, BITS = 128, 3
#: Words are counted pair by pair if no more than one pair in so many may be similar.
SCARCE = 200


def long_words(text: Column) -> Column:
    """The distinct white-space words of more than three characters, lower-cased."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[\t-\r ]+")), lambda w: F.length(w) > 3)


def similar(new: DataFrame, held: DataFrame, above: float) -> DataFrame:
    """(new_id, held_id, jaccard) of rows (id, block, words) of one block with a Jaccard index above a bound.

    Of held rows with equal words in a block the smallest id stands for all; a new row meets no held row of its own id.
    Rows without words meet none.
    """
    each = [_hashed(d) for d in (new, held)]
    a, b = (_chunks(written(d.select("block", "set", "words").dropDuplicates(["block", "set"]))) for d in each)
    near = written(_crossed(a, b, above).mapInArrow(_counted(above), "block string, new_set long, held_set long, jaccard double"))
    # Two held rows at most stand for equal sets: the smallest id, and the next one for a new row that is itself the smallest.
    out = each[0].select("id", "block", F.col("set").alias("new_set")).join(near.join(_least_two(each[1]), ["block", "held_set"]), ["block", "new_set"])
    held_id = F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    return out.select(F.col("id").alias("new_id"), held_id.alias("held_id"), "jaccard").where("held_id is not null")


def _hashed(rows: DataFrame) -> DataFrame:
    """A table (id, block, set, words) of rows with words, which are told apart when it is read: filtered before, texts would be split twice."""
    words = rows.where("block is not null").select("id", F.col("block").cast("string").alias("block"), F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("words"))
    return written(words.select("id", "block", F.when(F.size("words") > 0, F.xxhash64("words")).alias("set"), "words")).where("set is not null")


def _least_two(rows: DataFrame) -> DataFrame:
    """(block, held_set, first, second): the two smallest ids of equal sets, without gathering them."""
    rows = rows.select("block", F.col("set").alias("held_set"), "id")
    first = rows.groupBy("block", "held_set").agg(F.min("id").alias("first"))
    rest = rows.join(first, ["block", "held_set"]).where("id > first").groupBy("block", "held_set").agg(F.min("id").alias("second"))
    return first.join(rest, ["block", "held_set"], "left")


def _chunks(sets: DataFrame) -> DataFrame:
    """A table of chunks: (block, low, high, sets, sizes, words, starts, rows), the last five as bytes. ``words`` ascend;
    the sets with the i-th of them are ``rows[starts[i]:starts[i + 1]]``."""
    sets = sets.withColumn("size", F.size("words")).withColumn("step", F.floor(F.log("size") / math.log(STEP)).cast("int"))
    most = F.greatest(F.ceil(F.sum("size") / CHUNK_WORDS), F.ceil(F.count("*") / CHUNK_SETS))
    counted = written(sets.groupBy("block", "step").agg(most.cast("int").alias("parts")))
    n = counted.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    files = max(sets.sparkSession.sparkContext.defaultParallelism, -(-n // FILE_CHUNKS))
    dealt = sets.join(few(counted), ["block", "step"]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["size"].to_numpy(dtype=np.int32)
        flat = np.concatenate(pdf["words"].to_list()).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        words, starts = np.unique(flat[order], return_index=True)
        data = [pdf["set"].to_numpy(dtype=np.int64), sizes, words, np.append(starts, len(flat)).astype(np.int32), rows[order]]
        return pd.DataFrame([[key[0], int(sizes.min()), int(sizes.max()), *(d.tobytes() for d in data)]], columns=["block", "low", "high", *_PARTS])

    packed = dealt.repartition(files, "block", "step", "part").groupBy("block", "step", "part")
    return written(packed.applyInPandas(pack, "block string, low int, high int, " + ", ".join(f"{p} binary" for p in _PARTS)))


_PARTS = ["sets", "sizes", "words", "starts", "rows"]
_KINDS = [np.int64, np.int32, np.int64, np.int32, np.int32]


def _crossed(a: DataFrame, b: DataFrame, above: float) -> DataFrame:
    """Chunks of new and held sets of one block and near sizes. As in :mod:`vector`, no condition is an equality, so chunks are
    read where they meet."""
    a, b = (d.select(*(F.col(c).alias(f"{side}_{c}") for c in d.columns)) for d, side in ((a, "a"), (b, "b")))
    same = (F.col("a_block") <= F.col("b_block")) & (F.col("a_block") >= F.col("b_block"))
    return a.join(b, same & (F.col("a_low") * above < F.col("b_high")) & (F.col("b_low") * above < F.col("a_high")))


def _counted(above: float):
    """The similar pairs of chunks that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ([np.frombuffer(batch.column(f"{side}_{p}")[r].as_buffer(), dtype=k) for p, k in zip(_PARTS, _KINDS, strict=True)] for side in "ab")
                row, col, jaccard = _similar(a, b, above)
                block = pa.array([batch.column("a_block")[r].as_py()] * len(row), type=pa.string())
                yield pa.RecordBatch.from_arrays([block, pa.array(a[0][row]), pa.array(b[0][col]), pa.array(jaccard)], names=["block", "new_set", "held_set", "jaccard"])

    return run


def _similar(a: list[np.ndarray], b: list[np.ndarray], above: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two chunks of the pairs above a bound, and their Jaccard index."""
    row, col = _maybe(a, b, above)
    if len(row) * SCARCE <= len(a[1]) * len(b[1]):
        n, both = _shared_by(a, b, row, col), a[1][row].astype(np.int64) + b[1][col]
        jaccard = n / (both - n)
        keep = jaccard > above
        return row[keep], col[keep], jaccard[keep]
    shared = _shared(a, b)
    both = a[1][:, None] + b[1][None, :]
    row, col = np.nonzero(shared * np.float32(1 + above) > both * np.float32(above) - 1)
    n = shared[row, col].astype(np.int64)
    jaccard = n / (both[row, col] - n)
    keep = jaccard > above
    return row[keep], col[keep], jaccard[keep]


def _maybe(a: list[np.ndarray], b: list[np.ndarray], above: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may be above a bound: of m words in both sets together, similar ones differ in less than
    m * (1 - above) / (1 + above), and sketches in no more bits than sets in words."""
    apart = (1 - above) / (1 + above)
    d = LEAST_BITS + int(BITS * apart * (int(a[1].max()) + int(b[1].max())))
    (x, u), (y, v) = (_sketches(s, d, apart) for s in (a, b))
    # x @ y + u + v is half of the room that a pair has left; rounding stays well below the quarter.
    room = x @ y.T
    room += v
    return np.divmod(np.flatnonzero((room > -u[:, None] - np.float32(0.25)).ravel()), len(v))


def _sketches(chunk: list[np.ndarray], d: int, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, which of d bits an odd number of its words has, and half of what the set adds to the room less its odd bits."""
    _, sizes, words, starts, rows = chunk
    at = np.repeat((words.view(np.uint64) % np.uint64(d)).astype(np.int64), np.diff(starts))
    odd = (np.bincount(rows * np.int64(d) + at, minlength=len(sizes) * d).reshape(len(sizes), d) & 1).astype(np.float32)
    return odd, ((apart * sizes - odd.sum(axis=1, dtype=np.float64)) / 2).astype(np.float32)


def _shared_by(a: list[np.ndarray], b: list[np.ndarray], row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """How many words the sets of each pair share; the rows ascend."""
    out = np.zeros(len(row), dtype=np.int64)
    if not len(row):
        return out
    (a_words, a_ends), (b_words, b_ends) = _by_set(a), _by_set(b)
    firsts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    for first, last in zip(firsts.tolist(), [*firsts[1:].tolist(), len(row)], strict=True):
        i = row[first]
        own = a_words[a_ends[i] - a[1][i] : a_ends[i]]
        for k in range(first, last):
            other = b_words[b_ends[col[k]] - b[1][col[k]] : b_ends[col[k]]]
            at = np.searchsorted(own, other)
            at[at == len(own)] = 0
            out[k] = np.count_nonzero(own[at] == other)
    return out


def _by_set(chunk: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the sets one after the other, each set's ascending, and where sets end."""
    _, sizes, words, starts, rows = chunk
    order = np.argsort(rows.astype(np.uint16) if len(sizes) <= 1 << 16 else rows, kind="stable")
    return np.repeat(words, np.diff(starts))[order], np.cumsum(sizes)


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many words each set of one chunk shares with each of another."""
    (_, a_sizes, a_words, a_starts, a_rows), (_, b_sizes, b_words, b_starts, b_rows) = a, b
    at = np.minimum(np.searchsorted(b_words, a_words), len(b_words) - 1)
    i = np.flatnonzero(b_words[at] == a_words)
    j = at[i]
    a_n, b_n = a_starts[i + 1] - a_starts[i], b_starts[j + 1] - b_starts[j]
    pairs = a_n.astype(np.int64) * b_n
    often = pairs >= FREQUENT
    x, y = _having(a_starts, a_rows, i[often], len(a_sizes)), _having(b_starts, b_rows, j[often], len(b_sizes))
    out = (x @ y.T).ravel()  # whole numbers below 2^24
    i, j, b_n, pairs = i[~often], j[~often], b_n[~often].astype(np.int64), pairs[~often]
    ends = np.cumsum(pairs)
    start = 0
    while start < len(i):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS)))
        word = np.repeat(np.arange(start, stop), pairs[start:stop])
        within = np.arange(len(word)) - (ends - pairs - done)[word]
        high, low = np.divmod(within, b_n[word])
        place = a_rows[a_starts[i[word]] + high].astype(np.int64) * len(b_sizes) + b_rows[b_starts[j[word]] + low]
        out += np.bincount(place, minlength=len(out)).astype(np.float32)
        start = stop
    return out.reshape(len(a_sizes), len(b_sizes))


def _having(starts: np.ndarray, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """A matrix of which of n sets have which of some words."""
    m = np.zeros((n, len(words)), dtype=np.float32)
    for c, w in enumerate(words.tolist()):
        m[rows[starts[w] : starts[w + 1]], c] = 1
    return m
