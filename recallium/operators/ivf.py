"""Approximate neighbours by inverted lists, with filters, probes raised by need, and a measured recall.

Centroids are fitted on a bounded sample of the rows (``SAMPLE`` a list, ``MOST_LISTS`` lists at most) and every
row is put into the list of its nearest one. A query probes lists from the nearest centroid on. How
many it takes to reach a recall is measured on a bounded sample of rows against all rows (:meth:`Lists.calibrate`).

With a filter, a query's probes are tripled until the lists that it probes hold as many allowed rows as it
wants, which is known before any vector is compared: each list's allowed rows are counted first. All lists probed
is exact search. A query that would need more probes than ``most`` allows is answered as far as it goes and marked:
``excluded`` if the rows that the filter took away would have filled it, else ``truncated``.

Lists are cut into chunks of a bounded number of rows, so a hot one is only more chunks; chunk meets chunk by a
matrix product of which the best few of each query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vector
from .embeddings import usable

ROWS_A_LIST, MOST_LISTS, SAMPLE, ROUNDS = 64, 4096, 32, 8
CHECKED, TARGET = 128, 0.95


class Lists(NamedTuple):
    """Rows (doc_id, v, list), v of unit length, as a written table, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def _unit(v):
    n = vector.norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _units(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit length by a few rounds of spherical k-means, begun at evenly dealt rows."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[k : k + 4096] @ centroids.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.divide(total, length, out=centroids, where=length > 0)
    return centroids


def fit(rows: DataFrame, folder: str, lists: int | None = None) -> Lists:
    """Put all usable rows (doc_id, v) of the most frequent length into lists, written to a folder."""
    fine = rows.select("doc_id", F.col("v").cast("array<double>").alias("v")).where("doc_id is not null and v is not null").where(usable(F.col("v")))
    sizes = fine.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    fine = fine.where(F.size("v") == size).select("doc_id", _unit(F.col("v")).alias("v"))
    lists = min(lists or -(-n // ROWS_A_LIST), MOST_LISTS, n)
    if not lists:
        spark = rows.sparkSession
        return Lists(spark.createDataFrame([], "doc_id long, v array<double>, list int"), np.zeros((0, size)), 0)
    # A hash keeps about twice the rows wanted, of which the first are taken: a bounded, repeatable sample.
    wanted, h = SAMPLE * lists, F.xxhash64("doc_id")
    likely = fine if n <= 4 * wanted else fine.where(h < int((4 * wanted / n - 1) * (1 << 63)))
    sample = np.array([r["v"] for r in likely.orderBy(h, "doc_id", "v").limit(wanted).select("v").collect()])
    centroids = _fitted(sample, min(lists, len(sample)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_units(batch.column("v"), size) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("v"), pa.array(near.astype(np.int32))], names=["doc_id", "v", "list"])

    schema = "doc_id long, v array<double>, list int"
    fine.mapInArrow(dealt, schema).write.mode("overwrite").parquet(folder)
    return Lists(rows.sparkSession.read.schema(schema).parquet(folder), centroids, len(centroids))


def calibrate(index: Lists, k: int, target: float = TARGET) -> Lists:
    """The same with the fewest probes that find ``target`` of the k nearest of ``CHECKED`` rows."""
    if not index.probes:
        return index
    asked = index.rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CHECKED).select("doc_id", "v")
    near = vector.knn(asked, index.rows.select("doc_id", "v"), k).select("query_id", "doc_id")
    held = near.join(index.rows.select("doc_id", "list"), "doc_id").select("query_id", "list").collect()  # at most CHECKED * k rows, but for repeated ids
    vectors = {r["doc_id"]: np.array(r["v"]) for r in asked.collect()}
    place = {q: np.argsort(np.argsort(-(index.centroids @ v), kind="stable")) for q, v in vectors.items()}
    ranks = sorted(int(place[r["query_id"]][r["list"]]) for r in held)
    return index._replace(probes=ranks[min(int(np.ceil(target * len(ranks))), len(ranks)) - 1] + 1 if ranks else 1)


def search(queries: DataFrame, index: Lists, k: int, *, allowed: DataFrame | None = None, probes: int | None = None, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank, probed, scanned, excluded, degraded) of the k most similar allowed
    rows found, itself left out; ties to the smaller id. ``allowed`` holds the ids (doc_id) that may be found."""
    spark = queries.sparkSession
    schema = "query_id long, doc_id long, similarity double, rank int, probed int, scanned long, excluded long, degraded string"
    if not index.probes:
        return spark.createDataFrame([], schema)
    n_lists, size = index.centroids.shape
    probes = min(probes or index.probes, n_lists)
    most = min(most or n_lists, n_lists)
    fine = index.rows if allowed is None else index.rows.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    totals, counts = np.zeros(n_lists, dtype=np.int64), np.zeros(n_lists, dtype=np.int64)
    for table, into in ((index.rows, totals), (fine, counts)):
        for r in table.groupBy("list").count().collect():  # a row a list
            into[r["list"]] = r["count"]
    # So many chunks has each list; a query goes to all chunks of the lists that it probes.
    chunks = np.maximum(-(-counts // vector.CHUNK_ROWS), 1)
    centroids, raises = index.centroids, 0 if allowed is None else n_lists.bit_length()

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                v, ids = _units(part.column("v"), size), part.column("doc_id")
                order = np.argsort(-(v @ centroids.T), axis=1, kind="stable")
                has, seen = np.cumsum(counts[order], axis=1), np.cumsum(totals[order], axis=1)
                need = np.minimum((has < k + 1).sum(axis=1) + 1, n_lists)  # one more, as a query may be a row itself
                probed = np.full(len(v), probes)
                for _ in range(raises):
                    probed = np.where(probed < need, np.minimum(3 * probed, n_lists), probed)
                at = np.arange(len(v))
                short = probed > most
                probed = np.minimum(probed, most)
                scanned, found = seen[at, probed - 1], has[at, probed - 1]
                excluded = scanned - found
                state = np.where(~short, None, np.where(excluded >= k - np.minimum(found, k), "excluded", "truncated"))
                state = np.where(short & (found <= k), state, None)
                who = np.repeat(at, probed)
                lists = np.concatenate([order[j, :p] for j, p in enumerate(probed)])
                columns = [ids.take(pa.array(who)), part.column("v").take(pa.array(who)), pa.array(lists.astype(np.int32)), *(pa.array(x[who].astype(np.int64)) for x in (probed, scanned, excluded)), pa.array(state[who].tolist(), type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "q", "list", "probed", "scanned", "excluded", "degraded"])

    def packed(rows: DataFrame, keys: list[str], ids: str, v: str) -> DataFrame:
        """One row a chunk: ids and vectors as bytes."""

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by(ids)
            data = _units(table.column("v").combine_chunks(), size)
            keep = [table.column(c)[:1] for c in keys]
            return pa.table([*keep, pa.array([table.column(ids).to_numpy().tobytes()]), pa.array([np.ascontiguousarray(data).tobytes()])], names=[*keys, "ids", "data"])

        return rows.select(*keys, ids, F.col(v).alias("v")).groupBy(*keys).applyInArrow(pack, ", ".join(f"{c} int" for c in keys) + ", ids binary, data binary")

    asked = queries.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v")).where("doc_id is not null and v is not null").where(usable(F.col("v")) & (F.size("v") == size))
    plan = asked.select("doc_id", _unit(F.col("v")).alias("v")).mapInArrow(planned, "query_id long, q array<double>, list int, probed long, scanned long, excluded long, degraded string")
    per_list = spark.createDataFrame([(i, int(c)) for i, c in enumerate(chunks)], "list int, chunks int")  # MOST_LISTS rows
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)).cast("int")
    sizes = plan.groupBy("list").count().select("list", F.ceil(F.col("count") / vector.CHUNK_ROWS).cast("int").alias("blocks"))
    dealt = plan.select("list", "query_id", "q").join(F.broadcast(sizes), "list").withColumn("block", F.pmod(block, F.col("blocks")))
    blocks = packed(dealt, ["list", "block"], "query_id", "q").select("list", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    held = packed(fine.join(F.broadcast(per_list), "list").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")), ["list", "chunk"], "doc_id", "v")
    wide = blocks.join(F.broadcast(per_list), "list").select("list", "block", "q_ids", "q_data", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = wide.join(held, ["list", "chunk"]).select("q_ids", "q_data", "ids", "data")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64)
                near = np.round(np.frombuffer(r["q_data"]).reshape(len(own), -1) @ np.frombuffer(r["data"]).reshape(len(ids), -1).T, 9)
                near[own[:, None] == ids[None, :]] = -np.inf
                at = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ids ascend, so ties keep their order
                score = np.take_along_axis(near, at, axis=1).ravel()
                keep = score > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, at.shape[1])[keep]), pa.array(ids[at].ravel()[keep]), pa.array(score[keep])], names=["query_id", "doc_id", "similarity"])

    found = met.mapInArrow(best, "query_id long, doc_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    stated = plan.select("query_id", F.col("probed").cast("int").alias("probed"), "scanned", "excluded", "degraded").distinct()
    return ranked.join(stated, "query_id").select("query_id", "doc_id", "similarity", "rank", "probed", "scanned", "excluded", "degraded")


def index_of(spark: SparkSession, rows: DataFrame, folder: str, k: int) -> Lists:
    """Fit and calibrate in one go."""
    return calibrate(fit(rows, folder), k)
