"""Operator 12: repeated passages by the common-prefix interval trees of sparse suffix arrays.

A window is any run of ``least`` bytes of a text. It is anchored at the place in it where the hash of ``gram``
bytes is smallest (the first of equals), which depends on its bytes alone: equal windows are
anchored alike wherever they stand. Neighbouring windows mostly share their anchor; the bytes that they
cover together are the anchor's *context*, at most 2 * least bytes. So the suffixes that matter
are those that begin at anchors, one in some 150 places.

1. Anchors' hashes are counted over all texts. A bitmap of fixed size notes those of two places or more.
2. Contexts of such anchors are written, equal ones of a batch once, with the places where they stand.
3. Equal contexts fall together; those that stand twice are repeats as they are. The others meet the
   different contexts of their anchor's hash: sorted by what follows the anchor they are the suffix array
   of that hash, with the length of the prefix that neighbours share. A scan with a stack yields
   the tree of prefix intervals. In each interval the bytes before the anchors are compared from right to left,
   which splits it into runs that share a left extension: a run whose members differ both at the next
   byte to the left and, lying in two children of the interval, at the next to the right is a maximal repeat
   within contexts, with all its places.
4. The places of repeats are put together by text, and the bytes under them removed.

An anchor may have any number of different contexts, where a common passage ends. Beyond ``GROUP`` of them its windows are
dealt out by their own hash instead: each is a bucket of the suffix array whose common
prefix is the whole window, and a bucket with two members or more is a repeat. So no group grows in a task.

A repeat longer than a context comes in overlapping pieces, one an anchor. Texts are cut into segments for
memory's sake only; windows run across their ends.

Defined cases: a null text counts as empty; texts shorter than ``least`` bytes hold no repeat; rows that
repeat an id or a text are texts of their own, so that copies of a text remove each other whole;
removal may leave broken UTF-8, as bytes are what is compared; rows without an id keep null; an empty
table gives an empty result; extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _BASE_INVERSE, _BYTE_VALUES, _powers, bound_batches, give_back, if_few, materialize, mix64, release, slices, texts_of

LEAST, GRAM = 400, 96
#: Window starts of a segment, bits of the bitmap, and the most contexts of an anchor that meet in one task.
SEGMENT, BITMAP_BITS, GROUP = 1 << 19, 28, 4096

Place = tuple[int, int, int, int, int]


def _segments(texts: list[bytes], least: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) whose windows are all windows of the texts, each once."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for start in range(0, len(t) - least + 1, SEGMENT):
            part = t[start : start + SEGMENT + least - 1]
            held.append((i, start, part))
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(segments: list[tuple[int, int, bytes]], least: int, gram: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the segments' bounds, the starts of windows, and each one's anchor and its hash."""
    joined = b"".join(s[2] for s in segments)
    bounds = np.concatenate(([0], np.cumsum([len(s[2]) for s in segments])))
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, n), out=total[1:])
        hashes = (total[gram:] - total[:-gram]) * _powers(_BASE_INVERSE, n)[: n - gram + 1]
        ordered = (mix64(hashes) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=np.uint64)
    chosen = (_least_of(ordered, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(chosen), dtype=bool)
    for end in bounds[1:-1].tolist():
        inside[end - least + 1 : end] = False
    starts = np.flatnonzero(inside)
    at = chosen[starts]
    return joined, bounds, starts, at, mix64(hashes[at] + np.uint64(1))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    for c in columns:
        new[1:] &= c[1:] == c[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _repeated_anchors(docs: DataFrame, least: int, gram: int) -> np.ndarray:
    """A bitmap of the hashes of anchors that stand in two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for segments in _segments(texts_of(part.column("text")), least):
                    _, _, _, at, hashes = anchors(segments, least, gram)
                    found, times = np.unique(hashes[_runs(at)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2))], names=["anchor", "n"])
        give_back()

    counted = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bucket = F.shiftrightunsigned("anchor", 64 - BITMAP_BITS)
    words = counted.select(F.shiftright(bucket, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**22 rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap


def _marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bucket = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63)).astype(np.int64)) & 1 == 1


def _folded(places: list[tuple[int, int, int]], least: int) -> list[Place]:
    """(text, start) as runs (text, first, step, count) of steps that windows bridge."""
    out: list[list[int]] = []
    for k1, k2, start in sorted(places):
        if out and out[-1][:2] == [k1, k2]:
            run = out[-1]
            step = start - (run[2] + run[3] * (run[4] - 1))
            if step == 0:  # a row that repeats a text
                out.append([k1, k2, start, 0, 1])
                continue
            if step <= least and (run[4] == 1 or step == run[3]):
                run[3], run[4] = step, run[4] + 1
                continue
        out.append([k1, k2, start, 0, 1])
    return [tuple(p) for p in out]


_PLACE = "struct<k1: bigint, k2: bigint, start: bigint, step: bigint, count: bigint>"
_PLACE_ARROW = pa.struct([(n, pa.int64()) for n in ("k1", "k2", "start", "step", "count")])


def _contexts(docs: DataFrame, bitmap: np.ndarray, least: int, gram: int) -> DataFrame:
    """(anchor, digest, left, body, places): the contexts of marked anchors, equal ones of a run of text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                k1, k2 = part.column("k1").to_pylist(), part.column("k2").to_pylist()
                found: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}
                for segments in _segments(texts_of(part.column("text")), least):
                    joined, bounds, starts, at, hashes = anchors(segments, least, gram)
                    keep = _marked(hashes, bitmap)
                    starts, at, hashes = starts[keep], at[keep], hashes[keep]
                    if not len(starts):
                        continue
                    own = np.searchsorted(bounds, starts, side="right") - 1
                    begins = _runs(own, at, starts - np.arange(len(starts)))
                    ends = np.concatenate((begins[1:], [len(starts)])) - 1
                    for s, first, last, a, h in zip(own[begins].tolist(), starts[begins].tolist(), starts[ends].tolist(), at[begins].tolist(), hashes[begins].view(np.int64).tolist(), strict=True):
                        i, offset, _ = segments[s]
                        found.setdefault((h, a - first, joined[first : last + least]), []).append((k1[i], k2[i], offset + first - int(bounds[s])))
                if found:
                    folded = [_folded(p, least) for p in found.values()]
                    places = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, folded)]).astype(np.int32)), pa.array([p for f in folded for p in f], type=_PLACE_ARROW))
                    digests = [hashlib.blake2b(b"%d %d " % (h, left) + body, digest_size=16).digest() for h, left, body in found]
                    columns = [pa.array([k[0] for k in found], type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array([k[1] for k in found], type=pa.int32()), pa.array([k[2] for k in found], type=pa.binary()), places]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "left", "body", "places"])
        give_back()

    return docs.select("k1", "k2", "text").mapInArrow(run, f"anchor long, digest binary, left int, body binary, places array<{_PLACE}>")


def common(a: bytes, b: bytes) -> int:
    """The length of the prefix that two strings share."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(heights: list[int], above: int) -> Iterator[tuple[int, int, int]]:
    """The tree of intervals (height, first, last) of an array in which ``heights[i]`` is shared by
    members i - 1 and i: children before parents, those of at least a height only."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(heights) + 1):
        height, first = heights[i] if i < len(heights) else -1, i - 1
        while stack and stack[-1][0] > height:
            top, first = stack.pop()
            yield top, first, i - 1
        if height >= above and (not stack or stack[-1][0] < height):
            stack.append((height, first))


def maximal_repeats(members: list[tuple[int, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of ``least``
    bytes or more among different contexts (left, body) of one anchor."""
    rights = [body[left:] for left, body in members]
    lefts = [body[:left][::-1] for left, body in members]
    order = sorted(range(len(members)), key=rights.__getitem__)
    shared = [0, *(common(rights[a], rights[b]) for a, b in zip(order, order[1:]))]
    reach = max(map(len, lefts))
    for right, first, last in intervals(shared, max(least - reach, 1)):
        child, own = {order[first]: 0}, 0
        for i in range(first + 1, last + 1):
            own += shared[i] == right
            child[order[i]] = own
        by_left = sorted(order[first : last + 1], key=lefts.__getitem__)
        before = [0, *(common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:]))]
        for left, low, high in intervals(before, max(least - right, 0)):
            run = by_left[low : high + 1]
            if len({child[m] for m in run}) > 1:
                yield left, right, run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each anchor, of batches sorted by anchor."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["anchor"] != row["anchor"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_FOUND = "digest binary, repeat binary, first int, last int"


def _repeats(contexts: DataFrame, least: int, detail: bool, group: int) -> DataFrame:
    """(digest, repeat, first, last): where in a context repeats stand. Without ``detail`` those of
    a context that overlap are one, and ``repeat`` is null."""
    distinct = contexts.select("anchor", "digest", "left", "body", F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["count"]).alias("n"))
    distinct = materialize(distinct.groupBy("anchor", "digest").agg(F.first("left").alias("left"), F.first("body").alias("body"), F.sum("n").alias("n")), "distinct")
    whole = distinct.where("n > 1").select("digest", (F.unhex(F.sha2("body", 256)) if detail else F.lit(None).cast("binary")).alias("repeat"), F.lit(0).alias("first"), F.octet_length("body").alias("last"))
    sizes = materialize(distinct.groupBy("anchor").count().where("count > 1"), "sizes")

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["digest", "repeat", "first", "last"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            members = [(r["left"], r["body"]) for r in rows]
            if len(members) < 2:
                continue
            spans: dict[int, list[tuple[int, int]]] = {}
            for left, right, run in maximal_repeats(members, least):
                for m in run:
                    at = members[m][0]
                    if detail:
                        out.append((rows[m]["digest"], hashlib.sha256(members[m][1][at - left : at + right]).digest(), at - left, at + right))
                    elif rows[m]["n"] == 1:
                        spans.setdefault(m, []).append((at - left, at + right))
            out += [(rows[m]["digest"], None, first, last) for m, own in spans.items() for first, last in merged(own)]
            if len(out) > 10_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)
        give_back()

    few, many = sizes.where(F.col("count") <= group).select("anchor"), sizes.where(F.col("count") > group).select("anchor")
    met = distinct.join(if_few(few), "anchor", "left_semi").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, _FOUND)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                starts = range(len(r["body"]) - least + 1)
                hashes = [hashlib.blake2b(r["body"][k : k + least], digest_size=16).digest() for k in starts]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, type=pa.binary()), pa.array([r["digest"]] * len(hashes), type=pa.binary()), pa.array(starts, type=pa.int32()), pa.array([r["n"]] * len(hashes), type=pa.int64())], names=["repeat", "digest", "first", "n"])
        give_back()

    found = [whole, met]
    if not many.isEmpty():
        dealt = materialize(distinct.join(if_few(many), "anchor", "left_semi").select("digest", "body", "n").mapInArrow(windows, "repeat binary, digest binary, first int, n long"), "windows")
        twice = dealt.groupBy("repeat").agg(F.sum("n").alias("n")).where("n > 1").select("repeat")
        found.append(dealt.join(twice, "repeat", "left_semi").select("digest", ("repeat" if detail else F.lit(None).cast("binary").alias("repeat")), "first", (F.col("first") + least).alias("last")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch put together, in order."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (id, text, k1, k2): a text is known by two hashes of it."""
    bound_batches(df.sparkSession)
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(repeat, length, ``key``, start): every repeat, by the sha256 of its bytes, with all its places."""
    docs = _named(df, key, text)
    contexts = materialize(_contexts(docs, _repeated_anchors(docs, least, gram), least, gram), "contexts")
    found = materialize(_repeats(contexts, least, True, group), "repeats")
    places = contexts.select("digest", F.explode("places").alias("p"))
    starts = F.when(F.col("p.count") == 1, F.array("p.start")).otherwise(F.sequence("p.start", F.col("p.start") + F.col("p.step") * (F.col("p.count") - 1), F.greatest("p.step", F.lit(1))))
    at = places.join(found, "digest").select("repeat", (F.col("last") - F.col("first")).alias("length"), "p.k1", "p.k2", F.explode(starts).alias("start"), "first")
    at = at.select("repeat", "length", "k1", "k2", (F.col("start") + F.col("first")).alias("start")).distinct()
    return at.join(docs.select("k1", "k2", F.col("id").alias(key)), ["k1", "k2"]).select("repeat", "length", key, "start")


def remove(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    docs = _named(df, key, text)
    contexts = materialize(_contexts(docs, _repeated_anchors(docs, least, gram), least, gram), "contexts")
    found = _repeats(contexts, least, False, group).select("digest", "first", "last")
    places = contexts.select("digest", F.explode("places").alias("p"))
    spans = places.join(found, "digest").select("p.k1", "p.k2", (F.col("p.start") + F.col("first")).alias("first"), (F.col("p.start") + F.col("p.step") * (F.col("p.count") - 1) + F.col("last")).alias("last")).distinct()
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    out = T.StructType([df.select(key).schema[0], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, removed, counts, kept = [], [], [], []
                for body, own in zip(texts_of(part.column("text")), part.column("spans").to_pylist(), strict=True):
                    gone, at, left = merged([(s["first"], s["last"]) for s in own or []]), 0, []
                    for first, last in gone:
                        left.append(body[at:first])
                        at = last
                    left.append(body[at:])
                    sizes.append(len(body))
                    removed.append(sum(b - a for a, b in gone))
                    counts.append(len(gone))
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, type=pa.int64()) for c in (sizes, removed, counts)), pa.array(kept, type=pa.binary())], names=out.names)
        give_back()

    return docs.join(spans, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(run, out)
