"""Queries of the full-text index: weighted fields, choices of groups, stems, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fts, postings
from ..operators.postings import FORMAT, Postings
from ..sources.shared import shared_dir, state_of
from ..sources.tables import Tables, sql
from . import textual
from .search import fields, live_index, r6

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def choices(t: Tables) -> DataFrame:
    """Each benchmark item's first half of words or its second half."""
    w = t.raw("benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("w")).withColumn("half", F.ceil(F.size("w") / 2).cast("int"))
    return w.select("query_id", F.concat_ws(" OR ", F.array_join(F.slice("w", F.lit(1), F.col("half")), " "), F.array_join(F.slice("w", F.col("half") + 1, F.size("w")), " ")).alias("query"))


_TOK, _STOP = textual.TOK, textual._STOP
_GROUPS_SQL = f"""bw AS (SELECT item_id AS query_id, {_TOK.format(x='text')} AS w FROM benchmark),
sides AS (SELECT query_id, 0 AS part, w[1:ceil(len(w) / 2)::INT] AS w FROM bw UNION ALL SELECT query_id, 1, w[ceil(len(w) / 2)::INT + 1:] FROM bw),
kept AS (SELECT query_id, part, CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_STOP}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_STOP})) ELSE w END AS w FROM sides),
asked AS (SELECT query_id, part, len(list_distinct(w)) AS n_terms, prefix, count(*) AS times FROM (SELECT *, unnest(w) AS prefix FROM kept) GROUP BY query_id, part, w, prefix)"""


@query("query_groups", "", f"WITH {_GROUPS_SQL} SELECT query_id, part, prefix, times, n_terms FROM asked")
def query_groups(t: Tables) -> DataFrame:
    """Prefixes of each part of a query that offers a choice."""
    return postings.groups(choices(t)).select("query_id", "part", "prefix", "times", "n_terms")


@query(
    "weighted_search", "docs",
    f"""WITH {_GROUPS_SQL},
    words AS (SELECT id AS doc_id, {_TOK.format(x="collection || '/' || path")} AS p, {_TOK.format(x='title')} AS h, {_TOK.format(x='body')} AS b FROM docs WHERE active AND NOT invalidated),
    hit AS (SELECT doc_id, len(p) + len(h) + len(b) AS dl, unnest(p) AS term, 10 AS weight FROM words UNION ALL SELECT doc_id, len(p) + len(h) + len(b), unnest(h), 1 FROM words UNION ALL SELECT doc_id, len(p) + len(h) + len(b), unnest(b), 1 FROM words),
    idx AS (SELECT doc_id, dl, term, sum(weight) AS tf FROM hit GROUP BY ALL),
    stats AS (SELECT count(*) AS n_docs, avg(len(p) + len(h) + len(b)) AS avgdl FROM words),
    expanded AS (SELECT prefix, term FROM (SELECT DISTINCT term FROM idx), (SELECT DISTINCT prefix FROM asked) WHERE starts_with(term, prefix)),
    hits AS (SELECT prefix, doc_id, dl, sum(tf)::DOUBLE AS tf FROM idx JOIN expanded USING (term) GROUP BY ALL),
    dfs AS (SELECT prefix, count(*) AS df FROM hits GROUP BY prefix),
    weighted AS (SELECT prefix, doc_id, greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM hits JOIN dfs USING (prefix), stats),
    parts AS (SELECT query_id, part, n_terms, doc_id, sum(w * times) AS w, count(*) AS hit FROM asked JOIN weighted USING (prefix) GROUP BY ALL)
    SELECT query_id, doc_id, round(sum(w)::DOUBLE, 6) AS bm25, round(sum(w)::DOUBLE / (1 + sum(w)::DOUBLE), 6) AS score FROM parts GROUP BY query_id, doc_id HAVING max(hit = n_terms)""",
)
def weighted_search(t: Tables) -> DataFrame:
    """Documents that hold either half of an item, hits in paths counting ten times."""
    found = postings.weighted_search(choices(t), live_index(t))
    return found.select("query_id", "doc_id", r6(F.col("bm25")).alias("bm25"), r6(fts.bounded_score(F.col("bm25"))).alias("score"))


@query("stemmed_search")
def stemmed_search(t: Tables) -> DataFrame:
    """The same by stems."""
    return postings.weighted_search(choices(t), live_index(t, stemmed=True)).select("query_id", "doc_id", r6(F.col("bm25")).alias("bm25"))


_CHANGED = "CASE WHEN id % 5 = 1 THEN title || ' ' || lang ELSE body END"


@query("postings_after_changes", "docs", f"WITH w AS (SELECT id AS doc_id, {_TOK.format(x=_CHANGED)} AS w FROM docs WHERE active AND NOT invalidated AND id % 7 <> 3), idx AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM idx GROUP BY term")
def postings_after_changes(t: Tables) -> DataFrame:
    """Statistics of terms after a fifth of the documents were rewritten and a seventh removed, by increments and a merge."""
    state = state_of(t.spark, *(f"{t.folder}/{name}.parquet" for name in ("documents", "labels")))
    index = Postings(t.spark, f"{shared_dir(t.spark)}/recallium-postings-{FORMAT}-changes-{state}")
    # A batch that is there already is left out, so this goes on where an earlier run broke off.
    d = fields(t.documents).join(t.documents.select(F.col("id").alias("doc_id"), "lang"), "doc_id")
    index.apply(d, 0)
    index.apply(d.where("doc_id % 5 = 1").withColumn("body", F.concat("title", F.lit(" "), "lang")), 1)
    index.apply(d.where("doc_id % 7 = 3").withColumn("alive", F.lit(False)), 2)
    index.merge()
    return index.bodies().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
