"""What users call: search in one of several modes, retrieval that picks its mode, eval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, diversity, fts, fusion, models, vector
from ..sources.shared import few, written
from ..sources.tables import Tables, sql
from . import search as searching
from . import textual

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


@query("retrieve_router")
def retrieve_router(t: Tables) -> DataFrame:
    """Each question in the mode that its wording picks: keyword and timeline questions by BM25 (the
    latter newest first), all others by fused lists. (query_id, mode, doc_id, rank)."""
    asked = searching.questions(t).withColumn("mode", T.retrieval_mode(F.col("query")))
    by_word = searching.searched(t).select("query_id", "doc_id", F.col("search").alias("score"), F.lit("word").alias("lane"))
    by_fusion = searching.blended(t).select("query_id", "doc_id", "score", F.lit("fusion").alias("lane"))
    wanted = F.when(F.col("mode").isin("keyword", "timeline"), "word").otherwise("fusion")
    found = by_word.unionByName(by_fusion).join(asked.select("query_id", "mode", wanted.alias("lane")), ["query_id", "lane"])
    dated = t.documents.select(F.col("id").alias("doc_id"), "modified_at").join(few(found), "doc_id")
    newest = F.when(F.col("mode") == "timeline", F.unix_timestamp("modified_at"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(newest), F.desc(F.round("score", 9)), "doc_id")
    return dated.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "mode", "doc_id", "rank")


@query("surfaced_context", "docs", f"WITH {searching.SEARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM surface), b AS (SELECT r.query_id, r.doc_id, r.score, r, ceil(least(length(body), 300) / 4) AS tokens FROM r JOIN docs ON docs.id = r.doc_id), s AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY r) AS total FROM b) SELECT query_id, doc_id, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'HOT' WHEN score > 0.6 THEN 'WARM' ELSE 'COLD' END AS tier FROM s WHERE r = 1 OR total <= 800")
def surfaced_context(t: Tables) -> DataFrame:
    """What a prompt gets to see: results in order within a budget of tokens, with their tiers."""
    from ..functions import scoring as S

    d = t.documents.select(F.col("id").alias("doc_id"), F.least(F.length("body"), F.lit(300)).alias("shown")).join(few(searching.searched(t)), "doc_id").withColumn("tokens", F.ceil(F.col("shown") / 4))
    kept = fusion.within_budget(d, "query_id", [F.desc(F.round("score", 9)), "doc_id"], "tokens", 800)
    return kept.select("query_id", "doc_id", F.round("score", 6).alias("score"), S.tier(F.col("score")).alias("tier"))


@query("snippets", "docs", f"WITH {searching.SEARCH_SQL}, l AS (SELECT s.query_id, s.doc_id, terms, string_split(body, chr(10)) AS l FROM surface s JOIN docs ON docs.id = s.doc_id JOIN qt ON qt.query_id = s.query_id), e AS (SELECT query_id, doc_id, terms, unnest(range(len(l))) AS pos, unnest(l) AS line FROM l), h AS (SELECT query_id, doc_id, pos, len(list_filter(terms, lambda x: contains(lower(line), x))) AS hits FROM e) SELECT query_id, doc_id, arg_max(pos, struct_pack(h := hits, a := -pos)) + 1 AS line, max(hits) AS hits FROM h GROUP BY query_id, doc_id")
def snippets(t: Tables) -> DataFrame:
    """The line of each result with most of the query's terms, the first of equals."""
    terms = searching.questions(t).select("query_id", T.query_terms(F.col("query")).alias("terms"))
    found = few(searching.searched(t).select("query_id", "doc_id").join(terms, "query_id"))
    d = t.documents.select(F.col("id").alias("doc_id"), "body").join(found, "doc_id")
    best = d.select("query_id", "doc_id", fts.best_line(F.col("body"), F.col("terms")).alias("best"))
    return best.select("query_id", "doc_id", (1 - F.col("best.at")).cast("long").alias("line"), F.col("best.hits").cast("long").alias("hits"))


@query("similar_documents")
def similar_documents(t: Tables) -> DataFrame:
    """Documents like those of the stated queries, by vectors of their titles and whole texts."""
    d = t.texts.where("active").select(F.col("id").alias("doc_id"), F.concat_ws("\n", "title", "body").alias("text"))
    v = written(models.embed(d, "text", models.HashedWords()).drop("text"))
    return vector.knn(v.where("doc_id % 100 = 0"), v, 10)


@query("fragment_search")
def fragment_search(t: Tables) -> DataFrame:
    """Vector search over chunks: the ten documents with the chunk most like each question."""
    pieces = chunk.explode_chunks(t.texts.where("active")).select("doc_id", "seq", "chunk")
    v = written(models.embed(pieces, "chunk", models.HashedWords()).drop("chunk"))
    # Questions get negative ids, so that none is taken for a document.
    asked = models.embed(searching.questions(t).select((-1 - F.col("query_id")).alias("doc_id"), "query"), "query", models.HashedWords()).drop("query")
    return vector.nearest_documents(asked, v, 10).select((-1 - F.col("query_id")).alias("query_id"), "doc_id", F.col("similarity").alias("score"), "rank")


@query("expanded_queries", "", f"WITH {searching.QUESTIONS_SQL} SELECT q.query_id, unnest(['lex', 'vec', 'hyde']) AS type, unnest([array_to_string(list_sort(terms), ' '), query, 'Information about ' || query]) AS text FROM questions q JOIN qt USING (query_id)")
def expanded_queries(t: Tables) -> DataFrame:
    e = searching.questions(t).select("query_id", F.explode(models.expand(F.col("query"))).alias("e"))
    return e.select("query_id", "e.type", "e.text")


@query("reranked", "docs", f"WITH {searching.SEARCH_SQL}, w AS (SELECT id, list_distinct({textual.TOK.format(x='body')}) AS w FROM docs) SELECT s.query_id, doc_id, round(CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_intersect(terms, w)) / len(terms) END, 6) AS rerank FROM surface s JOIN qt ON qt.query_id = s.query_id JOIN w ON w.id = doc_id")
def reranked(t: Tables) -> DataFrame:
    found = few(searching.searched(t).select("query_id", "doc_id").join(searching.questions(t), "query_id"))
    d = t.documents.select(F.col("id").alias("doc_id"), "body").join(found, "doc_id")
    return d.select("query_id", "doc_id", F.round(models.overlap_score(F.col("query"), F.col("body")), 6).alias("rerank"))


@query("hybrid_with_diversity")
def hybrid_with_diversity(t: Tables) -> DataFrame:
    """The whole hybrid query: fused lists, reranked, near duplicates moved behind."""
    top = fusion.ranked(searching.blended(t), "score").where("rank < 20").select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))
    bodies = t.documents.select(F.col("id").alias("doc_id"), "body")
    return diversity.mmr(bodies.join(few(top), "doc_id").select("query_id", "doc_id", "rank", T.shingle_set(F.col("body")).alias("shingles")))
