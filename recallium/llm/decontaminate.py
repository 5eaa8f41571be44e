"""Operator 4: benchmark decontamination by SimHash of item-sized windows.

For every length that a benchmark item has, in words, windows of that length slide over each
document word by word. A window and an item are compared by their weighted shingles (five words;
the weight is the number of times that a shingle occurs): they match from a similarity of
sum(min)/sum(max) >= 0.75.

* Screening. That similarity needs six in seven of a window's shingles to be shingles of
  benchmark items, and of items of its length. A bitmap over the items' shingles, as they are and
  together with their item's length, tells which may be; windows with too few can't match and need no
  fingerprint.
* Multi-index Hamming blocks. A SimHash of 64 bits within ``RADIUS`` of an item's differs from
  it in at most RADIUS // BLOCKS bits of one of its ``BLOCKS`` blocks, so looking up each block
  among all variants of the items' blocks finds every fingerprint within the radius. Only
  numbers take part in the look-up; its pairs are counted out by their whole fingerprints.
* Verification. Candidates are held against the item's shingles exactly.

The radius is where recall is decided: of a window and an item of similarity 0.75, about 11 of
64 bits differ, give or take 3; at 18 one pair in a hundred at that very boundary is lost and
next to none above it, and of unrelated fingerprints one in 3000 is a candidate. The tests hold
recall to 0.97 of brute force on items whose copies lie around the boundary.

Words are runs of letters and digits, lower-cased. Defined cases: an item of fewer than five
words is one shingle of all its words, found where these stand; an item without words matches
nothing; a document shorter than an item is compared as a whole; null and empty texts match
nothing; equal items all match; items that repeat an id are compared one by one and the id gets
the best match of any, as do documents that repeat one; rows whose key is null, on either side,
can't be named and are left out of the matches; extra columns are never looked at; empty tables
give no match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, materialize, mix64, shingle_hashes, slices, without

WIDTH = 5
PERCENT = 75
RADIUS = 18
BLOCKS = 6
#: Bits of a hash that address the screening bitmap: by the benchmark's size, but never more than 32 MB.
LEAST_SCREEN_BITS, MOST_SCREEN_BITS = 24, 28
_RUN = 4096
#: Where each block of a fingerprint begins, and the end.
_EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]


def _words(texts: list[str | None]) -> Words:
    return Words([(t or "").lower().encode("utf-8", "replace") for t in texts], alphanumeric=True)


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of plus or minus one by bit (rows of 64)."""
    return np.bitwise_or.reduce((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=-1)


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1


def block_masks(k: int) -> list[int]:
    """What to change block ``k`` by for all values that differ in as many bits as it must allow.

    If every block k differed in more than t[k] bits, fingerprints would differ in at least the sum
    of t[k] + 1; so it suffices that this sum exceeds the radius."""
    most, size = (RADIUS + 1 + k) // BLOCKS - 1, _EDGES[k + 1] - _EDGES[k]
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(size), n)]


def _changed(value: Column, masks: list[int]) -> Column:
    """The value changed by each mask; the masks are one constant array, whose size isn't code."""
    return F.transform(F.lit(masks), lambda m: value.bitwiseXOR(m))


def block_keys(fingerprint: Column, variants: bool = False) -> Column:
    """Block number and value in one integer, for each block; with ``variants`` also for all
    values that :func:`block_masks` allows."""
    parts = []
    for k, (low, high) in enumerate(zip(_EDGES, _EDGES[1:], strict=False)):
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).cast("int").bitwiseOR(F.lit(k << 24))
        parts.append(_changed(value, block_masks(k)) if variants else F.array(value))
    return F.concat(*parts)


def weighted_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """sum(min)/sum(max) of the shingles' counts."""
    a, b = Counter(x.tolist()), Counter(y.tolist())
    both = sum((a & b).values())
    return both / max(1, len(x) + len(y) - both)


def items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Of each item with words and a key: a number of its own, key, number of words, shingle
    width, shingles, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = _words(part.column("text").to_pylist())
                n = np.diff(words.bounds)
                keys, rows = part.column("item").to_pylist(), []
                for width in range(1, WIDTH + 1):
                    values, bounds = shingle_hashes(words, width)
                    for i in np.flatnonzero(np.minimum(n, WIDTH) == width).tolist():
                        own = values[bounds[i] : bounds[i + 1]]
                        rows.append({"item": keys[i], "words": int(n[i]), "width": width, "item_shingles": own.tobytes(), "item_print": int(simhash(_signs(own).sum(axis=0)).view(np.int64))})
                rows = [r for r in rows if r["item"] is not None]
                yield from pa.Table.from_pylist(rows, schema=pa.schema([("item", part.column("item").type), ("words", pa.int32()), ("width", pa.int32()), ("item_shingles", pa.binary()), ("item_print", pa.int64())])).to_batches()
        give_back()

    narrow = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text"))
    made = narrow.mapInArrow(run, f"item {narrow.schema[0].dataType.simpleString()}, words int, width int, item_shingles binary, item_print long")
    return made.select(F.monotonically_increasing_id().alias("number"), "*")


def _of_length(shingles: np.ndarray, words: int) -> np.ndarray:
    """The shingles as those of windows or items of so many words."""
    return mix64(shingles + np.uint64(words))


def _hits(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of the first 0, 1, 2 ... values have their flag set."""
    hit = (flags[((values & np.uint64(64 * len(flags) - 1)) >> np.uint64(6)).astype(np.int64)] >> (values & np.uint64(63))) & np.uint64(1)
    return np.concatenate(([0], np.cumsum(hit.astype(np.int64))))


def _screen(known: DataFrame) -> np.ndarray:
    """One flag for each value of a shingle's lowest bits: whether an item has such a shingle, as
    it is or as one of the item's length."""
    shingles = known.agg(F.sum(F.octet_length("item_shingles") / 8)).first()[0] or 0
    size = min(MOST_SCREEN_BITS, max(LEAST_SCREEN_BITS, int(32 * shingles).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(np.frombuffer(x, dtype=np.uint64), w) for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            data = np.concatenate([y for x, w in own for y in (x, _of_length(x, w))] or [np.zeros(0, dtype=np.uint64)])
            bucket = np.unique(data & np.uint64((1 << size) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bucket >> 6).astype(np.int32)), pa.array((np.uint64(1) << (bucket & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = known.select("item_shingles", "words").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def _needed(n: int, m: int) -> int:
    """How many shingles a window of m and an item of n must share."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _windows(docs: DataFrame, lengths: list[tuple[int, int]], screen: np.ndarray) -> DataFrame:
    """Windows that pass the screen: doc, start, length of the items to compare with, shingles
    and fingerprint. Of windows of one text with the same shingles only the first."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)
    widths: dict[int, list[int]] = {}
    for words, width in lengths:
        widths.setdefault(width, []).append(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc").to_pylist()
                words = _words(part.column("text").to_pylist())
                found: list[tuple] = []
                for width, sizes in widths.items():
                    values, bounds = shingle_hashes(words, width)
                    total = _hits(flags, values)
                    in_doc = total[bounds[1:]] - total[bounds[:-1]]
                    least = min(_needed(s - width + 1, min(s - width + 1, PERCENT * (s - width + 1) // 100 or 1)) for s in sizes)
                    for i in np.flatnonzero(in_doc >= max(1, least)).tolist():
                        if ids[i] is not None:
                            low, high = bounds[i], bounds[i + 1]
                            found += [(ids[i], *w) for w in _of_document(values[low:high], total[low : high + 1], flags, width, sizes)]
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = [part.column("doc").type, pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "start", "words", "shingles", "print"])
        give_back()

    made = docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, start long, words int, shingles binary, print long")
    return made.select(F.monotonically_increasing_id().alias("window"), "*")


def _of_document(values: np.ndarray, total: np.ndarray, flags: np.ndarray, width: int, sizes: list[int]) -> Iterator[tuple]:
    for size in sizes:
        n = size - width + 1
        m = min(n, len(values))
        if _needed(n, m) > m:
            continue
        seen = set()
        starts = np.flatnonzero(total[m:] - total[: len(total) - m] >= _needed(n, m))
        if not len(starts):
            continue
        own = _hits(flags, _of_length(values, size))
        starts = starts[own[starts + m] - own[starts] >= _needed(n, m)]
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1) if len(starts) else ():
            for run in (group[k : k + _RUN] for k in range(0, len(group), _RUN)):
                low = int(run[0])
                sums = np.zeros((int(run[-1]) - low + m + 1, 64), dtype=np.int32)
                np.cumsum(_signs(values[low : int(run[-1]) + m]), axis=0, out=sums[1:])
                prints = simhash(sums[run - low + m] - sums[run - low]).view(np.int64)
                for start, p in zip(run.tolist(), prints.tolist(), strict=True):
                    shingles = values[start : start + m].tobytes()
                    if (p, shingles) not in seen:
                        seen.add((p, shingles))
                        yield start, size, shingles, p


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each (``key``, ``item_key``) that matches, with its best window's ``similarity``,
    ``start_word`` and ``n_words`` (ties: the first window, the shortest item)."""
    known = materialize(items(benchmark, item_key, item_text), "items")
    lengths = sorted((r["words"], r["width"]) for r in known.select("words", "width").distinct().collect())
    windows = materialize(_windows(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), lengths, _screen(known)), "windows")

    # Many windows have a passage that many documents share: each content is looked up and verified once.
    contents = windows.groupBy("words", "print", F.xxhash64("shingles").alias("content"), F.length("shingles").alias("size")).agg(F.min("window").alias("one"))
    looked_up = contents.select("words", "print", "one", F.explode(block_keys(F.col("print"))).alias("block"))
    index = known.select("number", "words", "item_print", F.explode(block_keys(F.col("item_print"), variants=True)).alias("block"))
    near = looked_up.join(index, ["words", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    candidates = near.select("one", "number").distinct()
    held = candidates.join(windows.select(F.col("window").alias("one"), "shingles"), "one").join(known.select("number", "item", "item_shingles"), "number")
    kind = known.schema["item"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("shingles", "item_shingles"))
            similar = np.array([weighted_similarity(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) for a, b in zip(x, y, strict=True)], dtype=np.float64)
            mask = pa.array(similar >= PERCENT / 100)
            yield pa.RecordBatch.from_arrays([batch.column("one").filter(mask), batch.column("item").filter(mask), pa.array(similar).filter(mask)], names=["one", "item", "similarity"])
        give_back()

    fits = held.select("one", "item", "shingles", "item_shingles").mapInArrow(verify, f"one long, item {kind}, similarity double")
    content = ["words", "print", "content", "size"]
    placed = windows.select("doc", "start", "words", "print", F.xxhash64("shingles").alias("content"), F.length("shingles").alias("size")).join(contents.join(fits, "one"), content)
    best = placed.groupBy("doc", "item").agg(F.max(F.struct("similarity", -F.col("start"), -F.col("words"))).alias("best"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start_word"), (-F.col("best.col3")).cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, with all their columns. The ids that
    match are written first: they are few, and so rows need not move."""
    bad = materialize(matches(docs, benchmark, key=key, text=text).select(key).distinct(), "matched")
    return without(docs, key, bad)
