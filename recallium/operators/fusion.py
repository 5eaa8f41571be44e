"""Putting ranked lists together, and orders of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, list, doc_id, rank from 0).

    Each place gives weight / (k + rank + 1), and 0.05 if first or 0.02 if second or third of its
    list, whatever the weight; lists of weight 0 are skipped.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, float(w)).otherwise(weight)
    bonus = F.when(F.col("rank") == 0, 0.05).when(F.col("rank") <= 2, 0.02).otherwise(0.0)
    scored = lists.withColumn("w", weight).where("w > 0").withColumn("s", F.col("w") / (k + F.col("rank") + 1) + bonus)
    return scored.groupBy("query_id", "doc_id").agg(F.sum("s").alias("rrf"))


def ranked(df: DataFrame, score: str, ties: str = "doc_id", by: str = "query_id") -> DataFrame:
    """With the rank from 0 in each query."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), ties)) - 1)


def rerank_blend(fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """0.1 of the fused score relative to the best and 0.9 of the reranker's; where the reranker
    gives a query nothing above 1e-4, the fused score alone."""
    both = fused.join(reranked, ["query_id", "doc_id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
    per = Window.partitionBy("query_id")
    top = F.max("rrf").over(per)
    return both.select("query_id", "doc_id", F.when(F.max("rerank").over(per) <= 1e-4, F.col("rrf") / top).otherwise(0.1 * F.col("rrf") / top + 0.9 * F.col("rerank")).alias("score"))


def position_blend(rank: Column, fused: Column, rerank: Column) -> Column:
    """The fused score counts 0.75 in the first three places, 0.6 up to the tenth, 0.4 beyond."""
    w = F.when(rank < 3, 0.75).when(rank < 10, 0.6).otherwise(0.4)
    return w * fused + (1 - w) * rerank


def keep_max(*lists: DataFrame) -> DataFrame:
    """The union of lists (query_id, doc_id, score) with the best score of each document."""
    whole = lists[0]
    for other in lists[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def within_budget(df: DataFrame, by: str, order: list, cost: str, budget: float) -> DataFrame:
    """Rows in order until the running cost goes beyond the budget; the first always stays, and
    nothing is taken after the first that doesn't fit."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_n", "_sum")


def adaptive(df: DataFrame, ratio: float, floor: float, activation: float) -> DataFrame:
    """Nothing for a query whose best is below the activation; else what reaches a share of the
    best, and the floor."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return df.withColumn("_best", best).where((F.col("_best") >= activation) & (F.col("score") >= F.greatest(F.col("_best") * ratio, F.lit(floor)))).drop("_best")


def strong_signal(df: DataFrame, top: float = 0.85, gap: float = 0.15) -> DataFrame:
    """(query_id, strong): whether the best is high and well ahead of the second."""
    first_two = ranked(df, "score").where("rank < 2")
    return first_two.groupBy("query_id").agg(F.max("score").alias("a"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("b")).select("query_id", ((F.col("a") >= top) & (F.col("a") - F.col("b") >= gap)).alias("strong"))


def metrics(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query of ``gold`` (query_id, doc_id): jaccard, precision, recall, hit and reciprocal
    rank of ``found`` (query_id, doc_id, rank from 0)."""
    f = found.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_found"))
    g = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    both = found.join(gold.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_both"), F.min("rank").alias("first"))
    m = g.join(f, "query_id", "left").join(both, "query_id", "left").fillna(0, ["n_found", "n_both"])
    n = F.col("n_both")
    return m.select(
        "query_id",
        (n / (F.col("n_gold") + F.col("n_found") - n)).alias("jaccard"),
        F.when(F.col("n_found") == 0, 0.0).otherwise(n / F.col("n_found")).alias("precision"),
        (n / F.col("n_gold")).alias("recall"),
        (n > 0).cast("int").alias("hit"),
        F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"),
    )
