"""Finding what a user means to change: by path, then by words, then by title, then by vector.

Each query is answered by the first way that finds anything for it, and leaves the plan there: a later way sees only
queries that no earlier one answered. Names in paths and titles are found by one automaton of all queries, so a
pass over the documents doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import automaton, meeting

# Words of a query that titles need not hold.
STOPWORDS = "a an the is are was were be been being in on at to for of with by from as and or not no but if then so do did has have had it its this that my our".split()
LIMIT, SURE, GAP = 5, 0.7, 0.2


def _first(found: DataFrame, order: list, source: str, limit: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)
    score = (1.0 - (F.col("rank") - 1) * 0.05) if source == "path" else F.col("score").cast("double")
    return ranked.select("query_id", "doc_id", score.alias("score"), F.lit(source).alias("source"), "rank")


def by_path(queries: DataFrame, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Queries with a slash or the ending .md: documents (doc_id, place, title) whose place holds them, in any case."""
    asked = queries.where(F.contains("query", F.lit("/")) | F.endswith("query", F.lit(".md"))).select("query_id", F.lower(F.regexp_replace("query", "^/", "")).alias("name"))
    hits = automaton.scan(docs, asked.select("name"), ["doc_id"], "place", boundaries=False)
    return _first(asked.join(hits, "name"), ["doc_id"], "path", limit)


def title_tokens(query: Column) -> Column:
    """The words of a query that count, letters and digits of them only; not distinct."""
    words = F.filter(F.split(F.lower(query), r"[\t-\r ]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) >= 2)


def by_title(queries: DataFrame, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Documents whose title holds half of a query's words, two at least, as parts of it."""
    words = queries.select("query_id", title_tokens(F.col("query")).alias("words")).where(F.size("words") > 0)
    each = words.select("query_id", F.size("words").alias("n"), F.explode("words").alias("prefix"))
    asked = written(each.groupBy("query_id", "prefix", F.col("n").alias("n_terms")).agg(F.count("*").alias("times")).withColumn("part", F.lit(0)))
    hits = automaton.scan(docs, asked.select(F.col("prefix").alias("name")), ["doc_id"], "title", boundaries=False)
    # A document's names meet queries as its terms would: one that begins another stands where that stands.
    laid = hits.groupBy("doc_id").agg(F.collect_list("name").alias("terms")).select("doc_id", F.lit(1).cast("long").alias("dl"), "terms", F.transform("terms", lambda _: F.lit(1.0)).alias("tfs"))
    met = meeting.meet(laid, asked, 1, 1.0, weighed=False, least=(2, 0.5)).select("query_id", F.col("n_terms").alias("n"), "doc_id", F.col("bm25").cast("long").alias("hit"))
    enough = met.join(docs.select("doc_id", "modified_at"), "doc_id")
    return _first(enough.withColumn("score", F.col("hit") / F.col("n")), [F.desc("hit"), F.desc("modified_at"), "doc_id"], "title", limit)


def candidates(queries: DataFrame, docs: DataFrame, by_words: Callable[[DataFrame], DataFrame], by_vector: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda d: d, limit: int = LIMIT) -> DataFrame:
    """(query_id, doc_id, score, source, rank): the best few of each query's first way that finds any.

    ``docs`` holds (doc_id, place, title, modified_at) of eligible documents; ``by_words`` and ``by_vector`` give
    (query_id, doc_id, score) for queries (query_id, query). ``keep`` may write a step's result to a table, so
    that later steps don't compute it again.
    """
    ways = [
        lambda q: by_path(q, docs, limit),
        lambda q: _first(by_words(q), [F.desc(F.round("score", 9)), "doc_id"], "fts", limit),
        lambda q: by_title(q, docs, limit),
        lambda q: _first(by_vector(q), [F.desc(F.round("score", 9)), "doc_id"], "vec", limit),
    ]
    left, out = queries, None
    for way in ways:
        found = keep(way(left))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return out


def targets(queries: DataFrame, found: DataFrame, sure: float = SURE, gap: float = GAP) -> DataFrame:
    """(query_id, doc_id, confident, outcome, outcome_if_destructive) of every query: the first candidate is the
    target; a change that can't be undone needs it to score well or to lie well ahead of a second one."""
    first = found.where("rank = 1").select("query_id", "doc_id", "score")
    second = found.where("rank = 2").select("query_id", F.col("score").alias("second"))
    both = queries.select("query_id").join(first, "query_id", "left").join(second, "query_id", "left")
    confident = F.coalesce((F.col("score") >= sure) | (F.round(F.col("score") - F.col("second"), 9) >= gap), F.lit(False))
    missing = F.col("doc_id").isNull()
    return both.select("query_id", "doc_id", confident.alias("confident"), F.when(missing, "not found").otherwise("target").alias("outcome"), F.when(missing, "not found").when(confident, "target").otherwise("ambiguous").alias("outcome_if_destructive"))
