"""Inverted lists and the store of embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.operators import ivf, vector
from recallium.operators.embeddings import Embeddings, ModelMismatch
from recallium.plans import neighbours
from recallium.sources.tables import Tables

SF = "/root/testdata/sf0.01"
ROWS = "doc_id long, v array<double>"
FRAGMENTS = "doc_id long, seq int, v array<double>"


def clustered(n, size=8, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, size)) * 3
    return [(i, (middle[i % 20] + rng.normal(size=size)).tolist()) for i in range(n)]


def test_recall_of_probed_search(spark):
    t = Tables(spark, SF)
    exact = {(r["query_id"], r["doc_id"]) for r in vector.knn(neighbours.asked(t), t.vectors, 10).collect()}
    found = {(r["query_id"], r["doc_id"]) for r in neighbours.probed_search(t).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_probes_follow_the_data_and_recall_holds(spark, tmp_path):
    rows = spark.createDataFrame(clustered(3000), ROWS)
    index = ivf.index_of(spark, rows, f"{tmp_path}/lists", 10)
    assert index.rows.count() == 3000 and 1 <= index.probes < len(index.centroids) / 3
    asked = rows.where("doc_id % 10 = 0")
    exact = {(r["query_id"], r["doc_id"]) for r in vector.knn(asked, rows, 10).collect()}
    found = ivf.search(asked, index, 10)
    assert len(exact & {(r["query_id"], r["doc_id"]) for r in found.collect()}) >= 0.9 * len(exact)
    assert found.agg(F.max("scanned")).first()[0] < 1500
    every = ivf.search(asked, index, 10, probes=len(index.centroids))
    assert {(r["query_id"], r["doc_id"]) for r in every.collect()} == exact


def test_probes_are_raised_until_there_are_enough_rows(spark, tmp_path):
    rows = spark.createDataFrame(clustered(1000), ROWS)
    index = ivf.fit(rows, f"{tmp_path}/lists")._replace(probes=1)
    rare = rows.where("doc_id % 50 = 7")  # twenty rows of one cluster
    asked = rows.where("doc_id in (0, 1, 7)")
    found = ivf.search(asked, index, 5, allowed=rare).collect()
    assert all(r["degraded"] is None and r["rank"] <= 5 for r in found) and len(found) == 15
    assert {r["doc_id"] % 50 for r in found} == {7}
    assert min(r["probed"] for r in found) < max(r["probed"] for r in found)
    short = ivf.search(asked, index, 5, allowed=rare, most=1).collect()
    assert {r["degraded"] for r in short if r["query_id"] != 7} <= {"excluded"}
    everything = ivf.search(asked, index, 2000, most=3, allowed=rows).collect()
    assert {r["degraded"] for r in everything} == {"truncated"}
    all_there_is = ivf.search(asked, index, 100, allowed=rare).collect()
    assert {r["degraded"] for r in all_there_is} == {None} and {r["probed"] for r in all_there_is} == {len(index.centroids)}


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    odd = [(1, None), (2, [None] * 8), (3, [float("nan")] * 8), (4, [1.0] * 7), (None, [1.0] * 8), (5, [0.0] * 8), (6, []), (7, [1.0] * 8), (7, [1.0] * 8), (8, [2.0] * 8)]
    index = ivf.index_of(spark, spark.createDataFrame(odd, ROWS), f"{tmp_path}/odd", 3)
    found = ivf.search(spark.createDataFrame(odd, ROWS), index, 3, probes=100).collect()
    assert {r["query_id"] for r in found} == {5, 7, 8} and all(r["query_id"] != r["doc_id"] for r in found)
    nothing = ivf.index_of(spark, spark.createDataFrame([], ROWS), f"{tmp_path}/none", 3)
    assert ivf.search(spark.createDataFrame(odd, ROWS), nothing, 3).count() == 0


def test_embeddings_are_replaced_by_document(spark, tmp_path):
    store, make = Embeddings(spark, str(tmp_path)), lambda rows: spark.createDataFrame(rows, FRAGMENTS)
    first = make([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0]), (3, 0, [0.5, 0.5])])
    assert store.apply(first, "m", 0) == 0 and store.apply(first, "m", 0) is None
    assert store.apply(make([(1, 0, [2.0, 0.0]), (3, 0, None), (4, 0, [1.0, 2.0]), (4, 0, [1.0, 3.0]), (None, 0, [1.0, 1.0])]), "m", 1) == 1
    want = [(1, 0, [2.0, 0.0]), (2, 0, [1.0, 1.0]), (4, 0, [1.0, 3.0])]
    held = lambda: sorted((r["doc_id"], r["seq"], r["v"]) for r in store.read().collect())
    assert held() == want and store.models() == [("m", 2, 3)]
    for rows, model in (([(9, 0, [1.0, 1.0])], "other"), ([(9, 0, [1.0])], "m"), ([(9, 0, [1.0, None])], "m"), ([(9, 0, [1.0, 1.0]), (8, 0, [1.0])], "m")):
        with pytest.raises(ModelMismatch):
            store.apply(make(rows), model)
    with pytest.raises(ModelMismatch):
        store.require("other", 2)
    (tmp_path / "2-2" / "rows").mkdir(parents=True)  # a batch that broke off
    assert held() == want and store.merge() and held() == want
    assert [r["doc_id"] for r in store.missing(spark.createDataFrame([(2,), (3,), (7,)], "doc_id long")).orderBy("doc_id").collect()] == [3, 7]
    store.clear()
    assert held() == [] and store.apply(make([(9, 0, [1.0] * 3)]), "other") is not None
    assert store.models() == [("other", 3, 1)]


def test_a_stream_may_give_a_batch_again(spark, tmp_path):
    store = Embeddings(spark, f"{tmp_path}/store")
    source = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(6)], FRAGMENTS)
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FRAGMENTS).parquet(f"{tmp_path}/in").writeStream
    for k in range(2):  # a fresh checkpoint gives batch 0 again
        stream.foreachBatch(lambda df, n: store.apply(df, "m", n)).option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start().awaitTermination()
    assert store.read().count() == 6 and store.segments() == [(0, 0)]
