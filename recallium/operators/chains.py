"""Chains of what took the place of what, and sets of documents with what holds among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def apply_contradictions(held: DataFrame, found: DataFrame, stamp) -> DataFrame:
    """Consolidated rows (id, status, invalidated_by, superseded_by, invalidated_at, ...) after contradictions
    (old_id, new_id, policy): ``supersede`` ends the old row, ``link`` only notes the new one on it.

    Of several contradictions of one row a superseding one holds, then that of the greatest new id.
    """
    ends = F.col("policy") == "supersede"
    best = found.groupBy(F.col("old_id").alias("id")).agg(F.max(F.struct(ends.alias("ends"), F.col("new_id").alias("by"))).alias("hit"))
    d = held.join(best, "id", "left")
    told, over = F.col("hit").isNotNull(), F.coalesce(F.col("hit.ends"), F.lit(False))
    return d.withColumns({
        "status": F.when(over, "inactive").otherwise(F.col("status")),
        "invalidated_by": F.when(told, F.col("hit.by")).otherwise(F.col("invalidated_by")),
        "superseded_by": F.when(over, F.col("hit.by")).otherwise(F.col("superseded_by")),
        "invalidated_at": F.when(over, stamp).otherwise(F.col("invalidated_at")),
    }).select(held.columns)


def last_members(links: DataFrame) -> DataFrame:
    """(id, last, steps, cyclic) of every member of chains (id, next): where its chain ends and how far away.

    Pointers are doubled: each round a member looks where its pointer points, so rounds grow with the logarithm of the
    longest chain. Members whose chain runs in a circle, or into one, have no last and are marked. Of several
    nexts of an id the greatest holds; a null next is no link; an id that follows itself is a circle.
    """
    once = links.where("id is not null and next is not null").groupBy("id").agg(F.max("next").alias("next"))
    ends = once.select(F.col("next").alias("id")).distinct().join(once.select("id"), "id", "left_anti")
    # at: where the pointer points; open: whether that member has a next of its own.
    state = once.join(ends.select(F.col("id").alias("next"), F.lit(True).alias("end")), "next", "left")
    state = written(state.select("id", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("end").isNull().alias("open")))
    left, most = state.where("open").count(), state.count()
    reach = 1
    while left and reach <= most:
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(ahead, "at").select("id", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        state = written(state.where("not open").unionByName(moved))
        left, reach = state.where("open").count(), 2 * reach
    done = state.select("id", F.when(~F.col("open"), F.col("at")).alias("last"), F.when(~F.col("open"), F.col("steps")).alias("steps"), F.col("open").alias("cyclic"))
    return done.unionByName(ends.select("id", F.col("id").alias("last"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("cyclic")))


def edges_within(sets: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(set_id, source_id, target_id, relation_type, weight, n): for every set of documents (set_id, doc_id) the
    heaviest edges with both ends in it, all sets at once.

    An edge meets the sets of its source, and stays if the set has its target as well. The join's own skew handling
    splits documents of many sets; the first ``most`` of a set are found in each task before they meet.
    """
    s = sets.select("set_id", "doc_id").where("set_id is not null and doc_id is not null").distinct()
    at = edges.join(s.withColumnRenamed("doc_id", "source_id"), "source_id")
    within = at.join(s.withColumnRenamed("doc_id", "target_id"), ["set_id", "target_id"], "left_semi")
    w = Window.partitionBy("set_id").orderBy(F.desc("weight"), "source_id", "target_id", "relation_type")
    return within.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("set_id", "source_id", "target_id", "relation_type", "weight", "n")


def relation_context(within: DataFrame) -> DataFrame:
    """(set_id, context): edges within sets as lines, the heaviest first."""
    line = F.format_string("doc#%d --[%s w=%.2f]--> doc#%d", "source_id", "relation_type", "weight", "target_id")
    listed = within.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))  # at most ``most`` a set
    return listed.select("set_id", F.array_join(F.col("lines.line"), "\n").alias("context"))


def anchors_of_sets(sets: DataFrame, mentions: DataFrame) -> DataFrame:
    """(set_id, entity): the entities (doc_id, entity) that documents of a set mention, each once."""
    return sets.select("set_id", "doc_id").distinct().join(mentions.select("doc_id", "entity"), "doc_id").select("set_id", "entity").distinct()


def link_targets(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` (..., collection, key) with ``target``: the document that alone has the key as its title or an alias.

    ``names`` holds (collection, doc_id, key), one row for each title and alias, keys normalised alike. A key that two
    documents of a collection have resolves to none.
    """
    alone = names.where("key is not null and key <> ''").groupBy("collection", "key").agg(F.min("doc_id").alias("target"), F.max("doc_id").alias("_most")).where("target = _most").drop("_most")
    return links.join(alone, ["collection", "key"], "left")
