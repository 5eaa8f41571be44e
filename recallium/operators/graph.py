"""Typed, weighted graphs of documents: edge rules, traversals, spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an edge of a type counts for a question's intent.
INTENT_WEIGHTS = {
    "WHY": {"causal": 5.0, "semantic": 2.0, "temporal": 0.5, "entity": 1.0},
    "WHEN": {"causal": 1.0, "semantic": 2.0, "temporal": 5.0, "entity": 0.5},
    "ENTITY": {"causal": 2.0, "semantic": 3.0, "temporal": 1.0, "entity": 6.0},
    "WHAT": {"causal": 1.0, "semantic": 5.0, "temporal": 1.0, "entity": 2.0},
}
FORWARD_ALPHA, FORWARD_LEAST = 0.15, 1e-4


def temporal_edges(docs: DataFrame, by: str | None = None) -> DataFrame:
    """From each document to the next one in time, over all or within a column's groups.

    Over all documents one window would be one task: documents are put in time buckets, linked
    within their bucket, and the ends of neighbouring buckets are linked apart.
    """
    if by:
        w = Window.partitionBy(by).orderBy("modified_at", "id")
        return docs.select(F.col("id").alias("source_id"), F.lead("id").over(w).alias("target_id")).where("target_id is not null")
    bucketed = docs.select("id", "modified_at", F.date_trunc("day", "modified_at").alias("bucket"))
    w = Window.partitionBy("bucket").orderBy("modified_at", "id")
    inner = bucketed.select(F.col("id").alias("source_id"), F.lead("id").over(w).alias("target_id")).where("target_id is not null")
    ends = bucketed.groupBy("bucket").agg(F.min(F.struct("modified_at", "id")).getField("id").alias("first"), F.max(F.struct("modified_at", "id")).getField("id").alias("last"))
    across = ends.select(F.col("last").alias("source_id"), F.lead("first").over(Window.orderBy("bucket")).alias("target_id")).where("target_id is not null")  # one row a day
    return inner.unionByName(across)


#: Groups of more members are paired chunk by chunk, in tasks of their own.
SPLIT = 64


def pairs_within(rows: DataFrame, group: str, item: str, split: int = SPLIT) -> DataFrame:
    """(group, a, b): the pairs of items of each group, a < b.

    A group of more than ``split`` members is dealt into chunks by a hash of the item, and each two chunks meet
    under a key of their own, so a long group is spread over tasks. The result holds every pair all the same.
    """
    long = rows.groupBy(group).agg(F.ceil(F.count("*") / split).cast("int").alias("_m")).where("_m > 1")
    dealt = rows.select(group, item).join(long, group, "left").withColumn("_m", F.coalesce("_m", F.lit(1))).withColumn("_c", F.pmod(F.xxhash64(item), F.col("_m")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = dealt.select(group, F.col(item).alias("a"), F.col("_c").alias("_x"), every.alias("_y"))
    right = dealt.select(group, F.col(item).alias("b"), F.col("_c").alias("_y"), every.alias("_x"))
    return left.join(right, [group, "_x", "_y"]).where("a < b").select(group, "a", "b")


def pair_counts(baskets: DataFrame, basket: str = "basket", item: str = "item") -> DataFrame:
    """(a, b, n): in how many baskets two items occur together, a < b."""
    return pairs_within(baskets, basket, item).groupBy("a", "b").agg(F.count("*").alias("n"))


def merged(edges: DataFrame, how: str) -> DataFrame:
    """One edge a (source_id, target_id, relation_type): weights added, the greatest, or the
    first seen (smallest ``seen``). Self loops go."""
    agg = {"sum": F.sum("weight"), "max": F.max("weight"), "first": F.min_by("weight", "seen") if "seen" in edges.columns else F.min("weight")}[how]
    return edges.where("source_id <> target_id").groupBy("source_id", "target_id", "relation_type").agg(agg.alias("weight"))


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """Of each node and type: outbound edges by weight before inbound ones, cut to n."""
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "relation_type", "weight", F.lit(0).alias("inbound"))
    back = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "relation_type", "weight", F.lit(1).alias("inbound"))
    w = Window.partitionBy("node", "relation_type").orderBy("inbound", F.desc("weight"), "other")
    return out.unionByName(back).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def forward_push(anchors: DataFrame, edges: DataFrame, path: list[str], n: int = 10) -> DataFrame:
    """Mass that reaches documents along a path of edge types from anchors (doc_id, score).

    At each hop a node keeps ``FORWARD_ALPHA`` of its mass; the rest is split over its top edges of
    the hop's type by weight. Mass at or under ``FORWARD_LEAST`` isn't carried on.
    """
    top = top_edges(edges, n)
    total = F.sum("weight").over(Window.partitionBy("node", "relation_type"))
    shares = top.withColumn("share", F.col("weight") / total)
    mass = anchors.select("doc_id", F.col("score").alias("mass"))
    kept = mass.select("doc_id", (F.col("mass") * FORWARD_ALPHA).alias("score"))
    for kind in path:
        step = mass.join(shares.where(F.col("relation_type") == kind), F.col("doc_id") == F.col("node")).select(F.col("other").alias("doc_id"), (F.col("mass") * (1 - FORWARD_ALPHA) * F.col("share")).alias("mass"))
        mass = step.groupBy("doc_id").agg(F.sum("mass").alias("mass")).where(F.col("mass") > FORWARD_LEAST)
        kept = kept.unionByName(mass.select("doc_id", (F.col("mass") * FORWARD_ALPHA).alias("score")))
    return kept.groupBy("doc_id").agg(F.sum("score").alias("score"))


def one_hop(anchors: DataFrame, edges: DataFrame, kind: str, per_anchor: int, limit: int) -> DataFrame:
    """Neighbours of anchors (query_id, doc_id, rank) over edges of a type, both ways: the best
    few of each anchor, then of each query by the anchor's rank, weight and id."""
    both = edges.where(F.col("relation_type") == kind)
    both = both.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "weight").unionByName(both.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "weight"))
    met = anchors.join(both, F.col("doc_id") == F.col("node")).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("weight"), "other"))).where(F.col("n") <= per_anchor)
    best = met.groupBy("query_id", "other").agg(F.min("rank").alias("best_rank"), F.max("weight").alias("best_weight"), F.array_sort(F.collect_set("doc_id")).alias("anchors"))
    w = Window.partitionBy("query_id").orderBy("best_rank", F.desc("best_weight"), "other")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query_id", F.col("other").alias("doc_id"), "best_rank", "best_weight", "anchors")


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(doc_id, depth): breadth first over edges both ways, each document at its least depth.

    A level is a join and an anti join; the number of levels is a small constant.
    """
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    seen = seeds.select("doc_id", F.lit(0).alias("depth"))
    level = seen
    for d in range(1, depth + 1):
        level = level.join(both, F.col("doc_id") == F.col("source_id")).select(F.col("target_id").alias("doc_id")).distinct().join(seen.select("doc_id"), "doc_id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen


def beam(anchors: DataFrame, edges: DataFrame, intent: str, hops: int, width: int) -> DataFrame:
    """Beam search from anchors (query_id, doc_id, score): at each hop a neighbour scores 0.9 of its
    parent and e**(0.6 * the type's weight for the intent) times the edge's weight; the best
    ``width`` new documents of each query go on. (query_id, doc_id, score) of all that were seen."""
    value = F.lit(0.0)
    for kind, w in INTENT_WEIGHTS[intent].items():
        value = F.when(F.col("relation_type") == kind, w).otherwise(value)
    both = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "weight", "relation_type")
    both = both.unionByName(edges.where(F.col("relation_type").isin("semantic", "entity")).select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "weight", "relation_type"))
    both = both.withColumn("value", F.exp(0.6 * value) * F.col("weight")).groupBy("node", "other").agg(F.max("value").alias("value"))
    seen = anchors.select("query_id", "doc_id", F.col("score").cast("double").alias("score"))
    front = seen
    for _ in range(hops):
        met = front.join(both, F.col("doc_id") == F.col("node")).groupBy("query_id", "other").agg(F.max(0.9 * F.col("score") + F.col("value")).alias("score")).withColumnRenamed("other", "doc_id")
        fresh = met.join(seen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        front = fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= width).select("query_id", "doc_id", "score")
        seen = seen.unionByName(front)
    return seen
