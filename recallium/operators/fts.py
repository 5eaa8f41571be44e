"""Full-text search: token index, prefix queries, BM25.

The index is (doc_id, term, tf) and one row a document with its length. A query is a set of AND
groups of prefixes. Of every term only the prefixes of the lengths that occur in the queries are
formed and looked up, so nothing is compared by LIKE; how documents meet queries is told in :mod:`meeting`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from . import meeting

#: How many documents a task lays out at once.
TASK_DOCS = 8192


def index(docs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(doc_id, term, tf, dl) of every document."""
    words = docs.select(F.col(key).alias("doc_id"), T.tokens(F.col(body)).alias("words"))
    return words.select("doc_id", F.explode("words").alias("term"), F.size("words").alias("dl")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def query_prefixes(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, prefix, n_terms): the terms of each query, without stopwords if others remain."""
    q = queries.select(F.col(key).alias("query_id"), T.query_terms(F.col(text)).alias("terms"))
    return q.select("query_id", F.explode("terms").alias("prefix"), F.size("terms").alias("n_terms"))


def by_document(indexed: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, dl, terms, tfs) of an index, a document a row; one that is kept so doesn't move."""
    if "terms" in indexed.columns:
        return indexed
    tasks = max(indexed.sparkSession.sparkContext.defaultParallelism, -(-n_docs // TASK_DOCS))
    of = indexed.repartition(tasks, "doc_id").groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"))).alias("each"))
    return of.select("doc_id", "dl", F.col("each.term").alias("terms"), F.col("each.tf").alias("tfs"))


def _met(queries: DataFrame, indexed: DataFrame, stats: DataFrame | None, **how) -> DataFrame:
    asked = written(query_prefixes(queries).withColumns({"part": F.lit(0), "times": F.lit(1)}))
    if stats is None:
        stats = indexed.select("doc_id", "dl").distinct().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    n_docs, avgdl = stats.first()
    return meeting.meet(by_document(indexed, n_docs), asked, n_docs, avgdl, **how)


def matches(queries: DataFrame, indexed: DataFrame, stats: DataFrame | None = None, *, match_all: bool = False, best: dict[str, int] | None = None) -> DataFrame:
    """(query_id, n_terms, doc_id, bm25, hit): documents that have any (or all) of a query's prefixes, and how many.

    The frequency of a prefix in a document is that of all its terms. Scores are positive. ``indexed`` is an index by
    term or, as :func:`by_document` gives it, by document. ``stats`` is one row (n_docs, avgdl), where it is known
    without the index. With ``best`` (how many by each order of :data:`meeting.ORDERS`), at least the best of each query.
    """
    return _met(queries, indexed, stats, every_group=match_all, best=best)


def overlaps(queries: DataFrame, indexed: DataFrame, stats: DataFrame) -> DataFrame:
    """:func:`matches` without scores: (query_id, n_terms, doc_id, hit)."""
    return _met(queries, indexed, stats, weighed=False).drop("bm25")


def search(queries: DataFrame, indexed: DataFrame, *, match_all: bool = True, stats: DataFrame | None = None, best: dict[str, int] | None = None) -> DataFrame:
    """(query_id, doc_id, bm25): documents that have all (or any) of a query's prefixes."""
    return matches(queries, indexed, stats, match_all=match_all, best=best).select("query_id", "doc_id", "bm25")


def bounded_score(bm25):
    """m / (1 + m), in [0, 1)."""
    m = F.greatest(F.lit(0.0), bm25)
    return m / (1 + m)


def best_line(text, terms):
    """The 1-based number and text of the line with most terms, the first of equals."""
    split = F.split(text, "\n")
    scored = F.transform(split, lambda line, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t))).alias("hits"), (-i).alias("at"), line.alias("line")))
    return F.array_max(scored)
