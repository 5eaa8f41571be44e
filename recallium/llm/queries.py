"""The queries opN_<name> over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, langid, licenses, repeats, sortmeans, tokencount, toxicity, urlrank, vptree, warc, whiten
from .common import table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text."""
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under five-word shingles and 0.75."""
    return jaccard.join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that match."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages into archives and read these back."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.page IS DISTINCT FROM p.page_id AND w.page IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.page IS DISTINCT FROM p.page_id THEN w.page END AS refers_to
FROM p LEFT JOIN w ON w.payload_digest = p.payload_digest
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose id is divisible by 20; exact."""
    return vptree.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, factor=1.0).withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH lengths AS (SELECT len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT n FROM lengths)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_reduce(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]), lambda s, t: s + t) AS score
  FROM e q JOIN e x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


def op8_urlrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlrank.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and licence labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    covers = F.transform("spans", lambda s: s["cover"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(covers), F.lit(0.0))).alias("score"),
    )


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document, by probabilities of pieces fitted on all of them."""
    docs, pieces = table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)
    return tokencount.counts(docs, pieces, tokencount.fit(docs, pieces))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the 32 main components, each scaled to variance one."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that stand elsewhere as well."""
    done = repeats.remove(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds from sixteen fixed vectors."""
    return sortmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_jaccard": op3_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_vptree": op7_vptree,
    "op8_urlrank": op8_urlrank,
    "op9_licenses": op9_licenses,
    "op10_tokencount": op10_tokencount,
    "op11_whiten": op11_whiten,
    "op12_repeats": op12_repeats,
    "op13_sortmeans": op13_sortmeans,
}
ORACLE: dict[str, str] = {"op3_jaccard": OP3_SQL, "op5_warc": OP5_SQL, "op7_vptree": OP7_SQL, "op8_urlrank": urlrank.oracle(), "op13_sortmeans": sortmeans.oracle()}
