"""Vector search in double precision: cosine, exact neighbours, graphs of similar documents.

Rows are packed into chunks of a bounded number of rows. A chunk of queries meets a chunk of rows
once, in a place of its own; a matrix product gives their similarities and only the best few of each
query leave it, so no pair is ever a row and a hot group is only more chunks. Vectors that are null or
hold a null, NaN or infinite component take no part, and only vectors of equal length meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for unlike lengths or a zero vector."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


CHUNK_ROWS = 1024


def _chunks(rows: DataFrame, block: str | None) -> DataFrame:
    """(block, chunk, ids, data): vectors of unit length (zero vectors stay) as bytes.

    A row's chunk follows a hash of its id and the number of rows of its block.
    """
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0)
    own = rows.where("v is not null").where(fine).select("doc_id", "v", F.concat_ws(":", F.size("v").cast("string"), F.col(block).cast("string") if block else F.lit("")).alias("block"))
    n = own.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    # Without a block there is a row for each length of vectors; joined by a shuffle, all vectors of a length would go to one task.
    dealt = own.join(n if block else F.broadcast(n), "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        data = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        size = np.sqrt((data**2).sum(axis=1, keepdims=True))
        data = np.divide(data, size, out=np.zeros_like(data), where=size > 0)
        return pd.DataFrame({"block": [key[0]], "chunk": [key[1]], "ids": [pdf["doc_id"].to_numpy(dtype=np.int64).tobytes()], "data": [data.tobytes()]})

    return dealt.groupBy("block", "chunk").applyInPandas(pack, "block string, chunk long, ids binary, data binary")


def knn(queries: DataFrame, rows: DataFrame, k: int, *, same_block: str | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, rank) of each query's k most similar rows but itself, by
    cosine rounded to 9 digits, ties to the smaller id.

    ``queries`` and ``rows`` have doc_id and v. With ``same_block``, a column of both, only rows
    of the query's own block are compared.
    """
    if same_block is None:
        return _ranked(_crossed(written(_chunks(queries, None)), written(_chunks(rows, None))).mapInArrow(_best(k), _FOUND), k)
    held = _chunks(rows, same_block)
    there = held.groupBy("block").agg(F.collect_list("chunk").alias("chunks"))  # one number for CHUNK_ROWS rows
    q = _chunks(queries, same_block).select("block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("chunk").alias("q_chunk"))
    q = q.join(there, "block").withColumn("chunk", F.explode("chunks")).drop("chunks").repartition("block", "chunk", "q_chunk")
    return _ranked(q.join(held, ["block", "chunk"]).select("q_ids", "q_data", "ids", "data").mapInArrow(_best(k), _FOUND), k)


_FOUND = "query_id long, doc_id long, similarity double"


def _crossed(q: DataFrame, held: DataFrame) -> DataFrame:
    """Every chunk of queries with every chunk of rows whose vectors are as long. The chunks are read where they meet and
    none is shuffled: said as an equality, the condition would send all of them to one task. By the hint a chunk of queries stays
    while those of rows go by, also where the queries are few enough to be broadcast."""
    q = q.hint("shuffle_replicate_nl").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    same = (F.col("q_block") <= F.col("block")) & (F.col("q_block") >= F.col("block"))
    return q.join(held.select("block", "ids", "data"), same).select("q_ids", "q_data", "ids", "data")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(k: int):
    """The k best rows of each query of the chunks that meet. While a chunk of queries stays, its best are kept, so what
    leaves a task doesn't grow with the chunks of rows that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = x = docs = score = seen = None

        def out() -> pa.RecordBatch:
            keep = score.ravel() > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, docs.shape[1])[keep]), pa.array(docs.ravel()[keep]), pa.array(score.ravel()[keep])], names=["query_id", "doc_id", "similarity"])

        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q_data, ids, data = (batch.column(c)[r].as_py() for c in ("q_ids", "q_data", "ids", "data"))
                if q_ids != seen or len(q_data) // len(q_ids) != len(data) // len(ids):
                    if seen is not None:
                        yield out()
                    seen, own, docs = q_ids, np.frombuffer(q_ids, dtype=np.int64), None
                    x = np.frombuffer(q_data).reshape(len(own), -1)
                docs, score = _merged(docs, score, own, np.frombuffer(ids, dtype=np.int64), x @ np.frombuffer(data).reshape(-1, x.shape[1]).T, k)
        if seen is not None:
            yield out()

    return run


def _merged(docs: np.ndarray | None, score: np.ndarray | None, own: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those kept and of a chunk's rows, by similarity rounded to 9 digits, ties to the smaller id."""
    near[own[:, None] == ids[None, :]] = -np.inf
    if docs is None or docs.shape[1] < k:
        near, ids = np.round(near, 9), np.broadcast_to(ids, near.shape)
        if docs is not None:
            near, ids = np.concatenate((score, near), axis=1), np.concatenate((docs, ids), axis=1)
            order = np.argsort(ids, axis=1, kind="stable")
            near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
        at = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ids ascend, so ties keep their order
        return np.take_along_axis(ids, at, axis=1), np.take_along_axis(near, at, axis=1)
    row, col = np.nonzero(near >= score[:, -1:] - 1e-9)  # what can't be among the best isn't sorted
    if not len(row):
        return docs, score
    rows = np.unique(row)
    all_rows = np.concatenate((np.repeat(rows, k), row))
    all_ids, all_near = np.concatenate((docs[rows].ravel(), ids[col])), np.concatenate((score[rows].ravel(), np.round(near[row, col], 9)))
    order = np.lexsort((all_ids, -all_near, all_rows))
    sorted_rows = all_rows[order]
    first = np.searchsorted(sorted_rows, rows)
    pick = order[(first[:, None] + np.arange(k)).ravel()]
    docs, score = docs.copy(), score.copy()
    docs[rows], score[rows] = all_ids[pick].reshape(-1, k), all_near[pick].reshape(-1, k)
    return docs, score


def nearest_documents(queries: DataFrame, fragments: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity, rank) of the k documents with the fragment most like each query (doc_id, v),
    itself left out. ``fragments`` has doc_id, seq and v.

    Of the fragments of a document in a chunk only the best leaves it, so a document of many fragments doesn't
    push others out.
    """
    held = _chunks(fragments.select("doc_id", "v"), None)
    q = _chunks(queries, None).select("block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("chunk").alias("q_chunk"))
    met = q.repartition("block", "q_chunk").join(held, "block").select("q_ids", "q_data", "ids", "data")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64)
                near = np.round(np.frombuffer(r["q_data"]).reshape(len(own), -1) @ np.frombuffer(r["data"]).reshape(len(ids), -1).T, 9)
                near[own[:, None] == ids[None, :]] = -np.inf
                starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))  # ids ascend
                near, docs = np.maximum.reduceat(near, starts, axis=1), ids[starts]
                at = np.argsort(-near, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(near, at, axis=1).ravel()
                keep = score > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, at.shape[1])[keep]), pa.array(docs[at].ravel()[keep]), pa.array(score[keep])], names=["query_id", "doc_id", "similarity"])

    found = met.mapInArrow(best, "query_id long, doc_id long, similarity double").groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_edges(rows: DataFrame, threshold: float, top: int) -> DataFrame:
    """Edges from each document to its most similar ones above a similarity."""
    return knn(rows, rows, top).where(F.col("similarity") > threshold).select(F.col("query_id").alias("source_id"), F.col("doc_id").alias("target_id"), F.col("similarity").alias("weight"))


def surprisal(rows: DataFrame, k: int) -> DataFrame:
    """Mean distance of each document to its nearest ones; equal vectors don't count."""
    near = knn(rows, rows, k + 1).where(1 - F.col("similarity") > 0.001)
    return near.groupBy(F.col("query_id").alias("doc_id")).agg(F.avg(1 - F.col("similarity")).alias("surprisal"))


def per_document(hits: DataFrame) -> DataFrame:
    """Of hits (query_id, doc_id, distance) of fragments, each document's nearest."""
    return hits.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance")).withColumn("score", 1 - F.col("distance"))
