"""Operator 13: centroid clustering by sort-means.

Vectors are whole numbers, floor(``scale`` * component), so that distances and means are exact.
For each centroid the others are sorted by their distance from it. A row is compared with the
centroid that it was last assigned to, and then with that one's others in their order, until
one lies strictly more than twice the row's distance from its last centroid away: by the triangle
inequality neither that one nor any behind it can be nearer or as near.

Rounds are passes of narrow tasks. Only the centroids (``k`` vectors) and the sums of clusters (k
vectors and counts, added by Spark) are on the driver. A row's last assignment isn't stored: a
task follows its rows through the centroids of the rounds so far, each scan beginning where the
one before ended, so nothing is written. After ``CHAIN`` rounds assignments are written with their
rows, so that the work of a pass doesn't grow with the number of rounds.

Defined cases: rows whose vector is null, hasn't ``size`` components or holds a null, NaN or infinite one
have no row in the result; rows without an id are clustered, but none begins as a centroid; rows
that repeat an id are rows of their own, and if their id is among the first, those with the smaller
vector come first; with fewer than k rows with an id there are fewer centroids, and with none (or
an empty table) the result is empty; ties go to the centroid of the smaller number; a centroid that loses its rows
stays where it is; components beyond +-2**26 (at 64 components) count as that bound, so that squared distances
fit a long; an inertia that doesn't is null; extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, release

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: After so many rounds the assignments are written.
CHAIN = 4
_MASK = (1 << 30) - 1


def largest(size: int) -> int:
    """The bound of components at which four times a squared distance fits a long."""
    return 1 << (58 - (size - 1).bit_length()) // 2


def _kept(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == size)).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def whole_numbers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    most = largest(size)
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64)


def assign(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, scanning from the last one."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    first = between.copy()
    np.fill_diagonal(first, -1)  # each is the first of its own list, before any that equals it
    order = np.argsort(first, axis=1, kind="stable")
    own = ((x - centroids[last]) ** 2).sum(axis=1)
    best, distance = last.copy(), own.copy()
    for a in np.unique(last).tolist():
        rows = np.flatnonzero(last == a)
        for other in order[a, 1:].tolist():
            rows = rows[4 * own[rows] >= between[a, other]]
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (other < best[rows]))
            hit = rows[nearer]
            best[hit], distance[hit] = other, d[nearer]
    return best, distance


def follow(x: np.ndarray, last: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Assignments and squared distances after all rounds of the history."""
    distance = np.zeros(len(x), dtype=np.int64)
    for centroids in history:
        last, distance = assign(x, last, centroids)
    return last, distance


def _measured(rows: DataFrame, history: list[np.ndarray], size: int, scale: int) -> dict[int, list[int]]:
    """By cluster: count, squared distances in two parts, sums of components. Exact."""
    k = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column("v"), size, scale)
            at, distance = follow(x, batch.column("at").to_numpy().astype(np.int64), history)
            parts = np.column_stack([np.ones(len(x), dtype=np.int64), distance >> 30, distance & _MASK, x])
            total = np.zeros((k, parts.shape[1]), dtype=np.int64)
            np.add.at(total, at, parts)
            there = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "parts"])
        give_back()

    added = rows.select("v", "at").mapInArrow(run, "cluster int, parts array<long>").select("cluster", F.posexplode("parts").alias("place", "part"))
    sums = added.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    found: dict[int, list[int]] = {}
    for r in sums.collect():  # k times (components + 3) numbers
        found.setdefault(r["cluster"], [0] * (size + 3))[r["place"]] = int(r["total"])
    return found


def _written(rows: DataFrame, history: list[np.ndarray], size: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = follow(whole_numbers(batch.column("v"), size, scale), batch.column("at").to_numpy().astype(np.int64), history)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32))], names=["id", "v", "at"])
        give_back()

    return materialize(rows.mapInArrow(run, "id long, v array<double>, at int"), "clusters")


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, *, seed: str = "1", key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row kept.

    The first centroids are the k rows with the smallest sha256 of ``seed:id``.
    """
    spark = df.sparkSession
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = _kept(df, key, vector, size).withColumn("at", F.lit(0))
    first = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], schema)
    most = largest(size)
    history = [np.clip(np.floor(np.array([r["v"] for r in first]) * scale), -most, most).astype(np.int64)]
    written = None
    for _ in range(rounds):
        centroids = history[-1].copy()
        for at, parts in _measured(rows, history, size, scale).items():
            centroids[at] = [s // parts[0] for s in parts[3:]]
        if len(history) == CHAIN:
            before, written = written, _written(rows, history, size, scale)
            rows, history = written, []
            if before is not None:
                release(before)
        history.append(centroids)
    inertia = {at: (parts[1] << 30) + parts[2] for at, parts in _measured(rows, history, size, scale).items()}
    per_cluster = [_long(inertia.get(c, 0)) for c in range(len(history[-1]))]
    whole = _long(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cluster, named = pa.array(per_cluster, type=pa.int64()), pa.array(digests)
        for batch in batches:
            at, distance = follow(whole_numbers(batch.column("v"), size, scale), batch.column("at").to_numpy().astype(np.int64), history)
            index = pa.array(at.astype(np.int32))
            total = pa.array([whole], type=pa.int64()).take(pa.array(np.zeros(len(at), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), index, pa.array(distance), by_cluster.take(index), total, named.take(index)], names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        give_back()

    return rows.mapInArrow(run, schema)


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL over ``embeddings``, with every distance computed."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS num, x AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY num < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT r, vec_id, x, m % {k} AS num, m // {k} AS distance FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({distance} * {k} + num) AS m FROM kept, c{i} GROUP BY r))")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT num, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {SIZE + 1})) AS j) GROUP BY num, j) GROUP BY num)")
            steps.append(f"c{i + 1} AS (SELECT num, coalesce(s.c, o.c) AS c FROM c{i} o LEFT JOIN s{i} s USING (num))")
    body = f"""SELECT vec_id, num::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY num))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (num)"""
    return "WITH " + ",\n".join(steps) + "\n" + body
