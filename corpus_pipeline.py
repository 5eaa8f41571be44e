"""A training-data pipeline: five stages over ``documents``, each written and read by the next.

Toxicity drops documents predicted toxic; language ID those without a letter or whose language is
no better than a coin's toss; the Jaccard join keeps the document with the smallest id of each
group of near duplicates (rows that repeat an id are one document); decontamination drops
documents that match a benchmark item; BPE encodes and decodes what is left. Rows whose id is
null are nobody's duplicate and match nothing, so only the first two stages may drop them. The
third and fourth write the ids to drop first; these go to every task if they are few enough, so that
texts need not be shuffled.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallium.llm import bpe, decontaminate, jaccard, langid, toxicity
from recallium.llm.common import bound_batches, keep_rows, materialize, release, table, without
from recallium.llm.queries import WORD_BPE

#: A document is kept if the score of its language is at least this.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, "text", lambda texts: [s < 0.5 for s in toxicity.scores(model, texts)], toxicity.forget)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    learned = langid.learn(docs)
    return keep_rows(docs, "text", lambda texts: [lang != langid.UNKNOWN and s >= LEAST_LANGUAGE_SCORE for lang, s in zip(*langid.predict(learned, texts), strict=True)], langid.forget)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = materialize(jaccard.join(docs).select("doc_id", "component_id"), "found")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = without(docs, "doc_id", gone)
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy("text", "lang", "source")
    once = kept.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return without(kept, "doc_id", again).unionByName(once.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    done = bpe.encode(docs, public_tokenizers.path(WORD_BPE))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]
#: No stage but the third can be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
