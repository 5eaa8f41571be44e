"""Operator 3: n-gram Jaccard join by parity sketches.

Every text is a set of shingles. A parity sketch is an array of blocks of 64 bits; each shingle
falls into one block, which is the XOR of its shingles' hashes. A shingle that only one of two
sets has changes one block, so the number of blocks in which two sketches differ is at most the
symmetric difference of the sets; with one bit for a shingle instead of a hash, so is their
Hamming distance. Sets with Jaccard similarity ``t`` differ in at most
``(|A| + |B|)(1 - t)/(1 + t)`` shingles.

* Size bands. Band j takes sets of 2**j to 2**(j+1) - 1 shingles; the number of blocks follows from
  the most in which two sets of the band can differ, ``SPREAD`` times as many, so that a block holds one
  to two shingles on average. A set that may have partners in the next band is sketched in that one too.
* Pigeonhole join. If two sets differ in at most d shingles, at most d of the blocks that are
  not zero in either of them differ. Put the blocks in one order for all texts: where more than d
  blocks of a text aren't zero, the first d + 1 of these include the first that both texts have, and
  it is among the first d + 1 of the other one. So each text sends its first d + 1 blocks, d for
  its largest possible partner, and texts are joined on equal (band, level, block, value). A text with
  too few blocks that aren't zero sends all of them and goes on to a level with four times as many.
  Blocks that many texts have come last in that order; a histogram of fixed size over all texts gives
  it, and spreads the few blocks over salts that are common and yet sent.
* Verification. Joined pairs face first the Hamming bound, on a sketch folded to 512 bits and on
  one of four times as many bits as shingles, then the exact shingle sets.

Groups that share a block may be large. No group is expanded into its pairs: first each text is
only paired with the smallest id of each of its groups; what links is merged into components;
then only those texts of a group that lie in different components are compared, chunk by chunk.
No link between texts of different components is lost.

Defined cases: null and empty texts have the empty set, no links and their own id as component;
rows with equal ids are one vertex that has the links of all of them; rows whose id is null
have a null component; equal texts have similarity 1 and link, unless empty; extra columns are
never looked at; an empty table gives an empty result. Only shingle hashes of 64 bits are
compared, so a wrong count within a pair is as likely as such a collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, materialize, mix64, release, shingle_hashes, slices, texts_of

WIDTH = 5
#: Jaccard similarity in percent from which texts link.
PERCENT = 75
#: Blocks of a sketch for each two in which two sets of the band may differ, and of the least sketch.
SPREAD, LEAST_BLOCKS = 3, 32
#: Buckets of the histogram that orders blocks; it has this size whatever the input.
BUCKETS = 1 << 18
#: Buckets of ids that are sent to every task before texts are joined with wanted ids.
ID_BUCKETS = 1 << 18
#: Texts that are compared with as many others in one place.
CHUNK_ROWS = 4096
#: Pairs of texts whose sketches are compared at once.
_PAIRS = 1 << 16
#: In finding components, neighbours of one vertex that meet in one place, unless so small a number makes more than ``HOT_VERTICES`` vertices hot.
NEIGHBOURS, HOT_VERTICES = 1000, 50_000
#: Words of the folded sketch of the Hamming test.
FOLDED = 8


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, bounds = shingle_hashes(Words(texts), width)
    return [np.unique(values[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]


def most_different(n: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference that a set of ``n`` can have with a similar one."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The bands in which a set of ``n`` shingles is joined."""
    band = n.bit_length() - 1
    return [band, band + 1] if n * 100 // percent >= 2 << band else [band]


def blocks_of_band(band: int, level: int = 0, percent: int = PERCENT) -> int:
    """By the most in which two sets of the band can differ."""
    most = 2 * ((2 << band) - 1) * (100 - percent) // (100 + percent) + 1
    return min(max(LEAST_BLOCKS, SPREAD * most // 2) << (2 * level), 1 << 31)


def sketch_blocks(shingles: np.ndarray, band: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks of the parity sketch of sorted shingles that aren't 0: one hash for (band,
    level, block number, value), and the value."""
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks_of_band(band, level))) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
    value = np.bitwise_xor.reduceat(mix64(shingles), starts)
    block = block[starts]
    if not value.all():
        block, value = block[value != 0], value[value != 0]
    with np.errstate(over="ignore"):
        return mix64(value + block * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band | level << 8)), value


def sent_blocks(shingles: np.ndarray, band: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that a text sends in a band and their buckets: of the order by bucket counts and
    hash, the first as many as it may differ from a partner in, and one."""
    sent, n = [], most_different(len(shingles)) + 1
    for level in range(16):
        keys, values = sketch_blocks(shingles, band, level)
        bucket = (values % np.uint64(BUCKETS)).astype(np.int64)
        if n < len(keys):
            place = (np.minimum(counts[bucket], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24))
            first = np.argpartition(place, n - 1)[:n]
            keys, bucket = keys[first], bucket[first]
        sent.append((keys, bucket))
        if len(keys) >= n:
            break
    return sent[0] if len(sent) == 1 else tuple(np.concatenate(x) for x in zip(*sent, strict=True))


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch with one bit for a shingle: four times as many bits as shingles, up to a
    power of two, 512 at least; in bytes. Folded to fewer bits it is the sketch of that width."""
    bits = max(64 * FOLDED, 1 << (4 * len(shingles) - 1).bit_length() if len(shingles) else 0)
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes by XOR."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches, the longer one folded."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def _sizes(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (id, n, sketch, the sketch folded to words) of each, and how many
    texts have blocks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        names = ["id", "n", "bucket", "sketch", *_sketch_names()]
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part.column("text")))
                values = [sketch_blocks(s, band)[1] for s in sets if len(s) for band in bands(len(s))]
                if values:
                    seen += np.bincount((np.concatenate(values) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                sketches = [bit_sketch(s) for s in sets]
                short = np.array([folded(s, 8 * FOLDED) for s in sketches]).view(np.int64)
                n = pa.array([len(s) for s in sets], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), n, pa.nulls(len(sets), pa.int32()), pa.array([s.tobytes() for s in sketches], type=pa.binary()), *(pa.array(np.ascontiguousarray(short[:, k])) for k in range(FOLDED))], names=names)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(seen[used]), pa.array(used.astype(np.int32)), pa.nulls(len(used), pa.binary()), *(pa.nulls(len(used), pa.int64()) for _ in range(FOLDED))], names=names)
        give_back()

    return docs.mapInArrow(run, "id long, n long, bucket int, sketch binary, " + ", ".join(f"{s} long" for s in _sketch_names()))


def _sent_blocks(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """The blocks that each text sends: (key, salt, id). ``counts`` says how many texts have blocks
    of a bucket: blocks of rare buckets come first, and those of common ones are spread over as
    many salts as ``salts_of`` says (salt -1: not spread)."""
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.uint32), salts_of(counts).astype(np.uint16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, spread = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_pylist()
                keys, owners, salts = [], [], []
                for i, s in zip(ids, shingle_sets(texts_of(part.column("text"))), strict=True):
                    if not len(s) or i is None:
                        continue
                    for band in bands(len(s)):
                        sent, bucket = sent_blocks(s, band, order)
                        keys.append(sent)
                        owners.append(np.full(len(sent), i, dtype=np.int64))
                        into = spread[bucket]
                        own = (mix64(np.array([i], dtype=np.int64).view(np.uint64))[0] % into.astype(np.uint64)).astype(np.int16)
                        salts.append(np.where(into > 1, own, np.int16(-1)).astype(np.int16))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(owners))], names=["key", "salt", "id"])
        give_back()

    return docs.mapInArrow(run, "key long, salt short, id long")


def salts_of(counts: np.ndarray) -> np.ndarray:
    """Into how many salts the blocks of each bucket are spread: 1 for all but common ones."""
    return np.clip(counts // (4 * int(counts.mean()) + 20_000), 1, 32_000)


def _groups(sent: DataFrame) -> DataFrame:
    """Of rows sorted by (key, salt, id): those of keys that several rows have or that are
    spread over salts, each with the smallest id of its (key, salt) as ``first``. Groups that have
    the same members are one: ``key`` is a hash of the members. ``wide`` is false for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # hashes of the groups' members; only spares work
        held = None  # the last group seen so far: (key, salt, first id, rows not yet given out)
        for batch in batches:
            key, salt, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            if held is not None and held[0] == key[0] and held[1] == salt[0]:
                first_of_run, goes_on = held[2], True
            else:
                first_of_run, goes_on = ids[0], False
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            first = ids[starts].copy()
            first[0] = first_of_run
            size = np.diff(np.concatenate((starts, [len(key)])))
            with np.errstate(over="ignore"):
                members = np.add.reduceat(mix64(ids.view(np.uint64)), starts)
            fresh = size > 1
            for g in np.flatnonzero(fresh[1:-1]) + 1:  # the first and last may go on in other batches
                m = int(members[g])
                fresh[g] = m not in seen
                seen.add(m)
            if len(seen) > 500_000:
                seen.clear()
            # A row alone in its group is let go once the group has ended: the batch's last one waits.
            take = fresh[group] | (salt >= 0)
            if goes_on:
                take |= group == 0
            wide = size > 2
            wide[[0, -1]] = True  # for all that this batch can tell
            # A group that is all here goes by its members, so that equal ones of other tasks fall together.
            whole = np.ones(len(starts), dtype=bool)
            whole[[0, -1]] = False
            named = np.where(whole[group] & (salt < 0), members.view(np.int64)[group], key)
            out = [named[take], ids[take], first[group][take], salt[take] >= 0, wide[group][take]]
            if goes_on and held[3]:
                out = [np.concatenate(([x], y)) for x, y in zip((held[0], held[2], held[2], False, True), out, strict=True)]
            last = group[-1]
            held = (key[-1], salt[-1], first[last], bool(size[last] == 1 and salt[-1] < 0 and not (goes_on and last == 0)))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, dtype=np.int64)) for x in out[:3]), *(pa.array(np.asarray(x, dtype=bool)) for x in out[3:])], names=["key", "id", "first", "salted", "wide"])
        seen.clear()
        give_back()

    return sent.mapInArrow(run, "key long, id long, first long, salted boolean, wide boolean")


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shingle set, 8 bytes a shingle, of each text in the pairs.

    Texts are joined with the ids wanted. Before that shuffle most others go: their ids' hash
    falls in none of the buckets of the ids wanted, of which there are ``ID_BUCKETS`` at most.
    """
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["id", "shingles"])
        give_back()

    likely = docs.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").select("id", "text")
    return likely.join(wanted, "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def _sketch_names() -> list[str]:
    return [f"s{k}" for k in range(FOLDED)]


def _near(pairs: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose whole sketches are near enough."""
    left = sizes.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    right = sizes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            mask = pa.array([_may_link(a, b, i + j, percent) for a, b, i, j in zip(x, y, n, m, strict=True)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
        give_back()

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that link, as a written table."""
    close = materialize(pairs, "pairs")
    sets = materialize(_sets(docs, close), "sets")
    links = materialize(_verified(close, sets, percent), "links")
    release(close, sets)
    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) that link by their exact sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
        give_back()

    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of an edge: its smallest reachable id.

    Large-star and small-star steps in turn, each a join and an aggregation over the edges, until
    the edges are stars around their components' smallest ids. Each step is a written table.
    The neighbours of a vertex are spread over salts where there are more than ``NEIGHBOURS``.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known, n = None, edges.count()
    while True:
        most = max(NEIGHBOURS, -(-2 * n // HOT_VERTICES))  # at most HOT_VERTICES vertices have as many neighbours

        def to_least(pairs: DataFrame) -> DataFrame:
            """(u, v) -> all (u, v, least of u and its v)."""
            least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / most).cast("int").alias("salts")).select("u", F.least("u", "m").alias("m"), "salts")
            hot = least.where("salts > 1").select("u", "salts")
            spread = pairs.join(F.broadcast(hot), "u", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts"))).cast("int")).drop("salts")
            return spread.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["u", "salt"]).drop("salt")

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = to_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "edges")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known, n = now, now[0]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _close(percent: int):
    """The condition that rows a and b pass the tests on sizes and folded sketches."""
    distance = F.lit(0)
    for s in _sketch_names():
        distance = distance + F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")))
    n, m = F.col("a.n"), F.col("b.n")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (distance * (100 + percent) <= (n + m) * (100 - percent))


def _star_pairs(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of every group, the smallest id with each other; where a key is spread over salts, the
    smallest of their smallest ids with each of these."""
    firsts = groups.where("salted").select("key", "first").distinct()
    firsts = firsts.join(firsts.groupBy("key").agg(F.min("first").alias("least")), "key")
    stars = groups.select("first", "id").unionByName(firsts.select(F.col("least").alias("first"), F.col("first").alias("id"))).where("first <> id").distinct()
    a, b = sketches.alias("a"), sketches.alias("b")
    return stars.join(b, stars["id"] == F.col("b.id")).join(a, (stars["first"] == F.col("a.id")) & _close(percent)).select(F.col("first").alias("a"), stars["id"].alias("b"))


def _open_pairs(groups: DataFrame, sketches: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs within groups that lie in different components, as far as they pass the tests
    on sizes and sketches.

    Groups of near duplicates overlap in many ways. So the texts of all groups with the same
    smallest component are compared at once, each being there but once; they are cut into chunks
    of about ``CHUNK_ROWS`` by a hash of the id, and each pair of chunks is looked at in one place,
    as arrays.
    """
    placed = groups.where("wide or salted").select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "low")
    around = materialize(placed.join(mixed, "key").select("low", "id", "component").distinct(), "around")
    chunks = around.groupBy("low").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    rest = around.join(chunks, "low").join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = rest.select("low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", *_sketch_names(), "sketch")

    def within(rows: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        i, j, own, ids, component, n = rows[:6]
        words, sketch = np.stack(rows[6:-1], axis=1).view(np.uint64), rows[-1]
        for low in range(0, len(ids), 256):
            part = slice(low, low + 256)
            apart = component[part, None] < component[None, :]
            if i[0] != j[0]:
                apart &= own[part, None] != own[None, :]
            a, b = np.nonzero(apart)
            a += low
            near = (n[a] * 100 >= n[b] * percent) & (n[b] * 100 >= n[a] * percent)
            pairs = np.stack((a[near], b[near]))
            for k in range(0, pairs.shape[1], _PAIRS):
                a, b = pairs[:, k : k + _PAIRS]
                near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if _may_link(sketch[x], sketch[y], n[x] + n[y], percent):
                        yield int(ids[x]), int(ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if pairs := list(within(group)):
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

        held: list[np.ndarray] | None = None  # columns of the group that may go on
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            low, i, j = columns[:3]
            if not len(low):
                continue
            cuts = np.flatnonzero((low[1:] != low[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts = [0, *cuts.tolist()]
            for begin, end in zip(starts, starts[1:], strict=False):
                yield from given([c[begin:end] for c in columns[1:]])
            held = [c[starts[-1] :] for c in columns]
        if held is not None and len(held[0]):
            yield from given(held[1:])
        held = None
        give_back()

    return rest.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _may_link(x: bytes, y: bytes, total: int, percent: int) -> bool:
    """Whether two sketches are as near as those of linked sets of ``total`` shingles in all."""
    return distance(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)) * (100 + percent) <= total * (100 - percent)


def join(df: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(``key``, n_shingles, component_id) for every row: the set's size and the smallest key
    reachable by links."""
    docs = _narrow(df, key, text)
    sizes = materialize(_sizes(docs), "sizes")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    # At most BUCKETS rows, as columns: as rows they would take the driver a hundred times as much.
    filled = sizes.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[filled.column("bucket").to_numpy()] = filled.column("n").to_numpy()
    del filled
    groups = materialize(_groups(_sent_blocks(docs, counts).repartition("key", "salt").sortWithinPartitions("key", "salt", "id")), "groups")
    known = sizes.where("bucket is null and id is not null and n > 0").drop("bucket")
    short = known.drop("sketch")
    links = _linked(docs, _near(_star_pairs(groups, short, percent), known, percent), percent)
    found = materialize(components(links), "components")
    more = _linked(docs, _open_pairs(groups, known, found, percent), percent)
    if not more.isEmpty():
        earlier, found = found, materialize(components(links.unionByName(more)), "components")
        release(earlier)
    release(groups, links, more)
    return (
        sizes.where("bucket is null")
        .join(found, "id", "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
