"""Entities: names, resolution, co-occurrence, expansion of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import few, written

#: The bucket in which names of a type are resolved against each other.
BUCKETS = {"person": "person", "organization": "org", "team": "org", "project": "project", "service": "project", "location": "location", "tool": "tool"}


#: The most entities that documents carry as bits.
BITS = 1024


def entity_id(vault: str, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit(vault), kind, T.slug(name))


def bucket(kind: Column) -> Column:
    found = kind
    for k, b in BUCKETS.items():
        found = F.when(kind == k, b).otherwise(found)
    return found


def good_name(name: Column, title: Column) -> Column:
    """Not the title itself, not longer than 60, no trailing colon."""
    return (T.similarity_ratio(F.lower(name), F.lower(title)) <= 0.85) & (F.length(name) <= 60) & ~F.endswith(name, F.lit(":"))


def resolve(names: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """Each (name, block) with the known entity of its bucket of types most like it, if alike enough.

    Candidates are found by words: those that share one with the name. Ties go to the smaller entity.
    """

    def words(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col("name").alias(column), "block", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""))).alias("word"))

    met = words(names, "name").join(words(known, "entity"), ["block", "word"]).select("name", "entity", "block").distinct()
    met = met.withColumn("ratio", T.similarity_ratio(F.lower("name"), F.lower("entity"))).where(F.col("ratio") >= least)
    w = Window.partitionBy("name", "block").orderBy(F.desc("ratio"), "entity")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select("name", "block", "entity", "ratio")


def idf(mentions: DataFrame) -> DataFrame:
    """(entity, df, idf): ln((N + 1) / (df + 1))."""
    n = mentions.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))
    return mentions.groupBy("entity").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("entity", "df", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)).alias("idf"))  # n is one row


def entity_edges(mentions: DataFrame, least_idf: float = 3.0) -> DataFrame:
    """Edges between documents that share entities, unless all of those are common.

    Entities of an idf below ``least_idf`` make no pairs of their own but count among the shared. Pairs are made once
    and never shuffled; their number is quadratic in how often an entity is mentioned. Names don't move with documents:
    of its rare entities a document carries numbers, the rarest first, of its common ones a bit each.
    """
    docs = written(mentions.groupBy("doc_id").agg(F.collect_set("entity").alias("all")))
    n_docs = docs.where("doc_id is not null").count()
    df = docs.select(F.explode("all").alias("entity")).groupBy("entity").agg(F.count("*").alias("df"))
    counted = written(df.select("entity", "df", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)).alias("idf")))
    # An entity of an idf below the bound stands in a share of all documents, so there are few of them; more have numbers.
    common = _numbered(counted.where(F.col("idf") < least_idf).orderBy(F.desc("df")).limit(BITS), ["entity"])
    known = _numbered(counted.join(F.broadcast(common), "entity", "left_anti"), ["entity", "df", "idf"])
    bits = F.broadcast(common.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("entity", "id"))), F.create_map().cast("map<string,int>")).alias("bits")))
    marked = docs.crossJoin(bits).select("doc_id", "all", F.filter(F.transform("all", lambda e: F.try_element_at("bits", e)), lambda b: b.isNotNull()).alias("at"), F.map_keys("bits").alias("names"))
    marked = written(marked.select("doc_id", F.array_except("all", "names").alias("rare"), *_packed(F.col("at"), common.count())))
    rare = marked.select("doc_id", F.explode("rare").alias("entity")).join(few(known), "entity").select("doc_id", F.struct("df", "id", "idf").alias("e"))
    parts = [c for c in marked.columns if c.startswith("bits_")]
    none = [F.lit(None).cast("long").alias(c) for c in parts]
    both = rare.select("doc_id", "e", *none).unionByName(marked.where(F.size("rare") > 0).select("doc_id", F.lit(None).cast(rare.schema["e"].dataType).alias("e"), *parts))
    own = written(both.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("e"), *(F.max(c).alias(c) for c in parts)))
    # Two documents meet under the rarest entity that both have and nowhere else. Both sides are the same exchange.
    each = own.select("doc_id", F.col("e.id").alias("own"), *parts, F.explode(F.filter("e", lambda x: x["idf"] >= least_idf)).alias("x")).select(F.col("x.id").alias("id"), F.col("x.idf").alias("idf"), "doc_id", "own", *parts)
    a, b = each.alias("a"), each.alias("b")
    met = a.hint("merge").join(b, F.col("a.id") == F.col("b.id")).where("a.doc_id < b.doc_id")
    met = met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.col("a.id").alias("id"), F.greatest("a.idf", "b.idf").alias("idf"), F.array_intersect("a.own", "b.own").alias("both"), *(F.bit_count(F.col(f"a.{c}").bitwiseAND(F.col(f"b.{c}"))).alias(c) for c in parts)).where(F.col("both")[0] == F.col("id"))
    n = F.size("both").cast("long")
    for c in parts:
        n = n + F.col(c)
    return met.select("a", "b", "idf", n.cast("long").alias("shared")).select("a", "b", "shared", F.least(F.lit(1.0), 0.3 + 0.12 * F.col("idf") + F.least(F.lit(0.15), 0.05 * (F.col("shared") - 1))).alias("weight"))


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as a table, with whole numbers from 0 on as ``id`` (int, while they fit)."""
    kept = written(rows.select(*columns, F.monotonically_increasing_id().alias("at")))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task that wrote
    n, starts = 0, []
    for r in sizes.orderBy("part").collect():
        starts.append((r["part"], n))
        n += r["n"]
    start = F.lit(0)
    for k, first in reversed(starts):
        start = F.when(part == k, F.lit(first)).otherwise(start)
    return kept.select(*columns, (start + row).cast("int" if n < 1 << 31 else "long").alias("id"))


def _packed(at: Column, n: int) -> list[Column]:
    """Columns of 64 bits each, those in ``at`` of bits 0 to n set."""

    def word(w: int) -> Column:
        own = F.filter(at, lambda k: F.floor(k / 64) == w)
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (k % 64).cast("int")))).alias(f"bits_{w}")

    return [word(w) for w in range(-(-n // 64))]


def neighbours(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, entity, n): what co-occurs with seeds, from either side of pairs (a, b, n)."""
    sides = pairs.select(F.col("a").alias("seed"), F.col("b").alias("entity"), "n").unionByName(pairs.select(F.col("b").alias("seed"), F.col("a").alias("entity"), "n"))
    return sides.join(seeds, "seed").groupBy("entity").agg(F.max("n").alias("n"))


def expansion(seeds: DataFrame, pairs: DataFrame, mentions: DataFrame, top_entities: int, per_entity: int, top_docs: int) -> DataFrame:
    """Documents reached from seed entities over co-occurring ones: scored by how often those
    occur together and how rare they are."""
    near = neighbours(seeds, pairs).join(idf(mentions), "entity")
    near = near.withColumn("score", F.least(F.lit(1.0), F.log1p(F.col("n").cast("double")) / 5) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("idf") / 3)))
    best = near.orderBy(F.desc("score"), "entity").limit(top_entities)
    docs = mentions.join(F.broadcast(best), "entity").withColumn("n_", F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))).where(F.col("n_") <= per_entity)
    own = mentions.join(seeds.withColumnRenamed("seed", "entity"), "entity", "left_semi").select("doc_id").distinct()
    return docs.join(own, "doc_id", "left_anti").groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_docs)
