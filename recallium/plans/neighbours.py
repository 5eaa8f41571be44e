"""Queries of vector search by inverted lists, and of the store of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ivf, vector
from ..operators.embeddings import Embeddings
from ..sources.shared import shared_dir, state_of
from ..sources.tables import Tables, sql
from .search import _SIM, r6

QUERIES, ORACLE = {}, {}
#: Grows when what is written changes.
FORMAT, K = 1, 10


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def _place(t: Tables, what: str) -> str:
    return f"{shared_dir(t.spark)}/recallium-{what}-{FORMAT}-{state_of(t.spark, f'{t.folder}/embeddings.parquet')}"


def lists(t: Tables) -> ivf.Lists:
    return ivf.index_of(t.spark, t.vectors, _place(t, "lists"), K)


def asked(t: Tables) -> DataFrame:
    return t.vectors.where("doc_id % 100 = 0")


def allowed(t: Tables) -> DataFrame:
    return t.documents.where("active and not invalidated and lang = 'en'").select(F.col("id").alias("doc_id"))


@query("probed_search")
def probed_search(t: Tables) -> DataFrame:
    """The ten most similar rows of the stated queries, found in as many lists as the measured recall takes."""
    return ivf.search(asked(t), lists(t), K).select("query_id", "doc_id", r6(F.col("similarity")).alias("similarity"), "rank", "probed")


@query("probed_search_filtered")
def probed_search_filtered(t: Tables) -> DataFrame:
    """The same among eligible documents, with more probes where lists hold few of them."""
    return ivf.search(asked(t), lists(t), K, allowed=allowed(t)).withColumn("similarity", r6(F.col("similarity")))


@query(
    "every_list_searched", "docs vectors",
    f"""WITH ok AS (SELECT id FROM docs WHERE active AND NOT invalidated AND lang = 'en'), n AS (SELECT count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT id FROM ok)) AS x FROM vectors)
    SELECT query_id, doc_id, round(similarity, 6) AS similarity, r AS rank, n AS scanned, x AS excluded FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS r FROM (SELECT a.doc_id AS query_id, b.doc_id, {_SIM} AS similarity FROM vectors a JOIN vectors b ON a.doc_id <> b.doc_id JOIN ok ON ok.id = b.doc_id WHERE a.doc_id % 100 = 0)), n WHERE r <= {K}""",
)
def every_list_searched(t: Tables) -> DataFrame:
    """With all lists probed the search is exact."""
    index = lists(t)
    found = ivf.search(asked(t), index, K, allowed=allowed(t), probes=len(index.centroids))
    return found.select("query_id", "doc_id", r6(F.col("similarity")).alias("similarity"), "rank", "scanned", "excluded")


def held(t: Tables) -> Embeddings:
    """Vectors as fragments of documents, ten vectors each; then some documents replaced and some taken away."""
    store = Embeddings(t.spark, _place(t, "embeddings"))
    # A batch that is there already is left out, so this goes on where an earlier run broke off.
    rows = t.vectors.select(F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).cast("int").alias("seq"), "v")
    store.apply(rows, "stored", 0)
    store.apply(rows.where("doc_id % 4 = 1 and seq < 3"), "stored", 1)
    store.apply(rows.where("doc_id % 9 = 2 and seq = 0").withColumn("v", F.lit(None).cast("array<double>")), "stored", 2)
    store.merge()
    return store


@query("embedded_fragments", "vectors", "SELECT doc_id // 10 AS doc_id, count(*) AS fragments, round(sum(list_sum(v)), 6) AS total FROM vectors WHERE doc_id // 10 % 9 <> 2 AND (doc_id // 10 % 4 <> 1 OR doc_id % 10 < 3) GROUP BY 1")
def embedded_fragments(t: Tables) -> DataFrame:
    """What is held of each document after its fragments were replaced or taken away."""
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x))
    return held(t).read().groupBy("doc_id").agg(F.count("*").alias("fragments"), r6(total).alias("total"))


@query("embedding_models", "vectors", "SELECT 'stored' AS model, len(any_value(v))::INT AS size, count(DISTINCT doc_id // 10) AS documents FROM vectors WHERE doc_id // 10 % 9 <> 2")
def embedding_models(t: Tables) -> DataFrame:
    return held(t).documents().where("alive").groupBy("model", "size").agg(F.count("*").alias("documents"))


@query("fragment_neighbours", "vectors", f"WITH f AS (SELECT doc_id // 10 AS doc_id, doc_id % 10 AS seq, v FROM vectors WHERE doc_id // 10 % 9 <> 2 AND (doc_id // 10 % 4 <> 1 OR doc_id % 10 < 3)), p AS (SELECT a.doc_id AS query_id, b.doc_id, max({_SIM}) AS similarity FROM f a JOIN f b ON a.doc_id <> b.doc_id WHERE a.doc_id % 10 = 0 AND a.seq = 0 GROUP BY ALL) SELECT query_id, doc_id, round(similarity, 6) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS r FROM p) WHERE r <= 5")
def fragment_neighbours(t: Tables) -> DataFrame:
    """The five documents with the fragment most like the first one of a stated document."""
    f = held(t).read()
    first = f.where("doc_id % 10 = 0 and seq = 0").select("doc_id", "v")
    return vector.nearest_documents(first, f, 5).withColumn("similarity", r6(F.col("similarity")))
