"""A vault of memories: tables in a folder, and what users do with them.

Each change of a table writes a new version of it beside the old ones and then notes that version
in ``_versions``, an append-only table; readers take the greatest version noted, so a job that dies
before the note changes nothing. Documents are never deleted: all removals are states.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .functions import time as Time
from .operators import fts, fusion, graph, lifecycle, models, vector
from .operators.postings import Postings
from .sources import readers

DOCUMENTS = (
    "id long, collection string, path string, title string, body string, hash string, content_type string, modified_at timestamp, last_accessed_at timestamp, access_count long, confidence double, quality_score double, "
    "pinned boolean, invalidated boolean, active boolean, snoozed_until timestamp, archived_at timestamp, reason string, revision_count long, duplicate_count long"
)
SCHEMAS = {
    "documents": DOCUMENTS,
    "relations": "source_id long, target_id long, relation_type string, weight double",
    "triples": "subject string, predicate string, object string, valid_from timestamp, valid_to timestamp, source_doc_id long",
    "sessions": "session_id string, started_at timestamp, ended_at timestamp, summary string",
    "diary": "agent string, at timestamp, entry string",
}


class Vault:
    """One vault. ``now`` is the clock that ages and stamps go by."""

    def __init__(self, spark: SparkSession, folder: str, now: datetime):
        self.spark, self.folder, self.now = spark, folder.rstrip("/"), now
        self._stamp = now.strftime("%Y-%m-%d %H:%M:%S")
        self._versions = "name string, version long, place string"

    # Tables

    def _noted(self) -> DataFrame:
        return self.spark.read.schema(self._versions).option("ignoreMissingFiles", "true").parquet(f"{self.folder}/_versions")

    def _latest(self, name: str) -> tuple[int, str] | None:
        try:
            row = self._noted().where(F.col("name") == name).agg(F.max(F.struct("version", "place")).alias("v")).first()["v"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return (row["version"], row["place"]) if row else None

    def table(self, name: str) -> DataFrame:
        """The current version of a table; empty before its first change."""
        found = self._latest(name)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{found[1]}")

    def commit(self, name: str, df: DataFrame) -> None:
        """A new version of a table."""
        found = self._latest(name)
        place = f"{name}/{uuid.uuid4().hex}"
        shape = self.spark.createDataFrame([], SCHEMAS[name]).columns
        df.select(shape).write.parquet(f"{self.folder}/{place}")
        note = [(name, found[0] + 1 if found else 1, place)]
        self.spark.createDataFrame(note, self._versions).coalesce(1).write.mode("append").parquet(f"{self.folder}/_versions")

    def _update(self, which, **changes) -> None:
        d = self.table("documents").withColumn("_hit", which)
        for column, value in changes.items():
            d = d.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        self.commit("documents", d)

    # Writing

    def index(self, root: str, collection: str, pattern: str = "*.md") -> dict[str, int]:
        """Bring a collection in line with a folder; how many files had which action."""
        scanned = readers.scan(self.spark, root, pattern)
        old = self.table("documents")
        own = old.where(F.col("collection") == collection)
        plan = readers.reconcile(scanned, own.select("path", "hash", "active"))
        known = own.select("path", "id", "revision_count", "access_count", "pinned", "confidence")
        fresh = scanned.join(plan.where(F.col("action").isin("insert", "update", "reactivate")), "path").join(known, "path", "left")
        rows = fresh.select(
            F.coalesce("id", F.abs(F.xxhash64(F.lit(collection), "path"))).alias("id"),
            F.lit(collection).alias("collection"),
            "path",
            F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"(?:^|\n)#{1,3} +([^\n]+)", 1)), F.lit("")), F.element_at(F.split("path", "/"), -1)).alias("title"),
            "body",
            "hash",
            T.content_type(F.col("path")).alias("content_type"),
            F.lit(self._stamp).cast("timestamp").alias("modified_at"),
            F.lit(None).cast("timestamp").alias("last_accessed_at"),
            F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
            F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
            T.quality_score(F.col("body")).alias("quality_score"),
            F.coalesce("pinned", F.lit(False)).alias("pinned"),
            F.lit(False).alias("invalidated"),
            F.lit(True).alias("active"),
            F.lit(None).cast("timestamp").alias("snoozed_until"),
            F.lit(None).cast("timestamp").alias("archived_at"),
            F.lit(None).cast("string").alias("reason"),
            (F.coalesce("revision_count", F.lit(0)) + 1).cast("long").alias("revision_count"),
            F.lit(1).cast("long").alias("duplicate_count"),
        )
        gone = plan.where("action = 'deactivate'").select("path", F.lit(collection).alias("collection"), F.lit(True).alias("_gone"))
        kept = old.join(gone, ["collection", "path"], "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).withColumn("reason", F.when(F.col("_gone"), "absent").otherwise(F.col("reason"))).drop("_gone")
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        if set(counts) - {"unchanged"}:
            self.commit("documents", lifecycle.upsert(kept.select(old.columns), rows.select(old.columns), ["collection", "path"]))
        return counts

    def pin(self, doc_id: int, on: bool = True) -> None:
        self._update(F.col("id") == doc_id, pinned=F.lit(on))

    def snooze(self, doc_id: int, until: str | None) -> None:
        self._update(F.col("id") == doc_id, snoozed_until=F.lit(until).cast("timestamp"))

    def forget(self, doc_id: int) -> None:
        self._update(F.col("id") == doc_id, active=F.lit(False), reason=F.lit("forget"))

    def touch(self, doc_ids: list[int]) -> None:
        """Count an access."""
        which = F.col("id").isin(doc_ids)
        self._update(which, access_count=F.col("access_count") + 1, last_accessed_at=F.lit(self._stamp).cast("timestamp"))

    def sweep(self, days: int, by_type: dict[str, int | None] | None = None, dry_run: bool = True) -> DataFrame:
        """Archive what has gone stale; the documents (id) that are, or would be, archived."""
        due = lifecycle.archive_candidates(self.table("documents"), self._stamp, days, by_type or {}).select("id", F.lit(True).alias("_due"))
        if not dry_run:
            d = self.table("documents").join(due, "id", "left")
            hit = F.col("_due").isNotNull()
            self.commit("documents", d.withColumn("active", F.col("active") & ~hit).withColumn("archived_at", F.when(hit, F.lit(self._stamp).cast("timestamp")).otherwise(F.col("archived_at"))).withColumn("reason", F.when(hit, "archive").otherwise(F.col("reason"))))
            return self.table("documents").where(F.col("archived_at") == F.lit(self._stamp).cast("timestamp")).select("id")
        return due.select("id")

    def restore(self, collection: str | None = None) -> None:
        """Bring archived documents back."""
        which = F.col("archived_at").isNotNull() & ~F.col("active")
        which = which & (F.col("collection") == collection) if collection else which
        self._update(which, active=F.lit(True), reason=F.lit(None).cast("string"), archived_at=F.lit(None).cast("timestamp"))

    def log_session(self, session_id: str, started_at: str, ended_at: str | None = None, summary: str | None = None) -> None:
        """A session, or what is newly known of it."""
        new = self.spark.createDataFrame([(session_id, started_at, ended_at, summary)], "session_id string, s string, e string, summary string")
        new = new.select("session_id", F.col("s").cast("timestamp").alias("started_at"), F.col("e").cast("timestamp").alias("ended_at"), "summary")
        old = self.table("sessions")
        known = lifecycle.patch(old, new.drop("started_at"), "session_id")
        self.commit("sessions", known.unionByName(new.join(old.select("session_id"), "session_id", "left_anti")))

    def write_diary(self, agent: str, entry: str) -> None:
        row = self.spark.createDataFrame([(agent, self.now, entry)], SCHEMAS["diary"])
        self.commit("diary", self.table("diary").unionByName(row))

    def add_fact(self, subject: str, predicate: str, object_: str, valid_from: str | None = None, source: int | None = None) -> None:
        """A fact; nothing new if it holds already."""
        held = self.table("triples")
        same = held.where("valid_to is null").where((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_))
        if same.isEmpty():
            row = self.spark.createDataFrame([(subject, predicate, object_, valid_from or self._stamp, source)], "subject string, predicate string, object string, f string, source_doc_id long")
            row = row.select("subject", "predicate", "object", F.col("f").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "source_doc_id")
            self.commit("triples", held.unionByName(row))

    def end_fact(self, subject: str, predicate: str, object_: str, at: str | None = None) -> None:
        t = self.table("triples")
        which = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_) & F.col("valid_to").isNull()
        self.commit("triples", t.withColumn("valid_to", F.when(which, F.lit(at or self._stamp).cast("timestamp")).otherwise(F.col("valid_to"))))

    def build_graphs(self, threshold: float = 0.7) -> dict[str, int]:
        """Temporal and semantic edges of the active documents; how many of each."""
        d = self.table("documents").where("active and not invalidated")
        temporal = graph.temporal_edges(d, "collection").select("source_id", "target_id", F.lit("temporal").alias("relation_type"), F.lit(1.0).alias("weight"))
        v = models.embed(d.select(F.col("id").alias("doc_id"), "collection", "body"), "body", models.HashedWords()).drop("body")
        semantic = vector.semantic_edges(v, threshold, 10).select("source_id", "target_id", F.lit("semantic").alias("relation_type"), "weight")
        others = self.table("relations").where(~F.col("relation_type").isin("temporal", "semantic"))
        self.commit("relations", others.unionByName(temporal).unionByName(semantic))
        return {r["relation_type"]: r["count"] for r in self.table("relations").groupBy("relation_type").count().collect()}

    # Reading

    def _live(self) -> DataFrame:
        awake = F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(self._stamp).cast("timestamp"))
        return self.table("documents").where(lifecycle.eligible() & awake)

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id long, query string")

    def _composite(self, hits: DataFrame) -> DataFrame:
        """Hits (doc_id, search) with their composite score."""
        d = hits.join(self.table("documents"), F.col("doc_id") == F.col("id"))
        age, since = Time.age_days(F.col("modified_at"), self._stamp), F.coalesce(Time.age_days(F.col("last_accessed_at"), self._stamp), F.lit(90.0))
        life = S.effective_half_life(F.col("content_type"), F.col("access_count"), since)
        sure = S.stored_blend(F.col("confidence"), S.confidence(F.col("content_type"), age, life, F.col("access_count"), Time.age_days(F.col("last_accessed_at"), self._stamp)))
        s = S.composite(F.col("search"), S.recency(age, life), sure, "query") * S.quality_factor(F.col("quality_score")) * S.length_factor(F.length("body")) * S.frequency_factor(F.col("revision_count"), F.col("duplicate_count"))
        return d.select("doc_id", "collection", "path", "title", "search", S.pinned(s, F.col("pinned")).alias("score"))

    def postings(self) -> Postings:
        """The full-text index, brought in line with the documents."""
        index = Postings(self.spark, f"{self.folder}/_postings")
        index.sync(self.table("documents").select(F.col("id").alias("doc_id"), F.concat_ws("/", "collection", "path").alias("path"), "title", "body", lifecycle.eligible().alias("alive")))
        return index

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """By words."""
        index = self.postings()
        found = fts.search(self._query(text), index.by_document(), stats=index.body_statistics())
        hits = found.join(self._live().select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", fts.bounded_score(F.col("bm25")).alias("search"))
        return self._composite(hits).orderBy(F.desc("score"), "doc_id").limit(limit)

    def vsearch(self, text: str, limit: int = 10, least: float = 0.3) -> DataFrame:
        """By vectors."""
        v = models.embed(self._live().select(F.col("id").alias("doc_id"), "body"), "body", models.HashedWords()).drop("body")
        q = models.embed(self._query(text).select(F.lit(-1).cast("long").alias("doc_id"), "query"), "query", models.HashedWords()).drop("query")
        hits = vector.knn(q, v, 3 * limit).where(F.col("similarity") >= least).select("doc_id", F.col("similarity").alias("search"))
        return self._composite(hits).orderBy(F.desc("score"), "doc_id").limit(limit)

    def query(self, text: str, limit: int = 10) -> DataFrame:
        """By words and vectors, fused by rank."""
        w = Window.orderBy(F.desc("search"), "doc_id")  # over the few results of one query
        lists = [d.select(F.lit(name).alias("list"), F.lit(0).alias("query_id"), "doc_id", (F.row_number().over(w) - 1).alias("rank")) for name, d in (("words", self.search(text, 30)), ("vectors", self.vsearch(text, 30)))]
        fused = fusion.rrf(lists[0].unionByName(lists[1]))
        best = self._composite(fused.select("doc_id", (F.col("rrf") / fused.agg(F.max("rrf")).first()[0]).alias("search"))) if not fused.isEmpty() else self.search(text, limit)
        return best.orderBy(F.desc("score"), "doc_id").limit(limit)

    def get(self, reference: str, first_line: int = 1, lines: int = 1_000_000) -> DataFrame:
        """A document by virtual path, path or the beginning of its hash."""
        ref = reference.split("://", 1)[-1].lstrip("#")
        at = (F.concat_ws("/", "collection", "path") == ref) | (F.col("path") == ref) | (F.startswith("hash", F.lit(ref)) if len(ref) >= 6 and not set(ref) - set("0123456789abcdef") else F.lit(False))
        return self.table("documents").where(F.col("active") & at).select("id", "collection", "path", "title", T.lines(F.col("body"), first_line, lines).alias("body"))

    def timeline(self, doc_id: int, n: int = 3) -> DataFrame:
        """What was there before and after a document in its collection."""
        d = self.table("documents").where("active")
        focus = d.where(F.col("id") == doc_id).select(F.col("collection").alias("c"), F.struct("modified_at", "id").alias("f"))
        near = d.join(F.broadcast(focus), F.col("collection") == F.col("c")).withColumn("k", F.struct("modified_at", "id"))  # focus is one row
        before = near.where("k < f").orderBy(F.desc("k")).limit(n).select("id", "title", F.lit("before").alias("side"))
        return before.unionByName(near.where("k > f").orderBy("k").limit(n).select("id", "title", F.lit("after").alias("side")))

    def related(self, doc_id: int, depth: int = 2, kind: str | None = None) -> DataFrame:
        """Documents that edges lead to, with their least distance."""
        e = self.table("relations")
        e = e.where(F.col("relation_type") == kind) if kind else e
        return graph.reachable(self.spark.createDataFrame([(doc_id,)], "doc_id long"), e, depth)

    def facts(self, subject: str, as_of: str | None = None) -> DataFrame:
        at = F.lit(as_of or self._stamp).cast("timestamp")
        return self.table("triples").where((F.col("subject") == subject) & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))

    def diary(self, agent: str, limit: int = 10) -> DataFrame:
        return self.table("diary").where(F.col("agent") == agent).orderBy(F.desc("at")).limit(limit)

    def sessions(self, limit: int = 10) -> DataFrame:
        minutes = (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")) / 60
        return self.table("sessions").withColumn("minutes", minutes).orderBy(F.desc("started_at"), "session_id").limit(limit)

    def status(self) -> DataFrame:
        """By collection: documents in all, active, pinned, snoozed, archived, and the last change."""
        return self.table("documents").groupBy("collection").agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if("pinned").alias("pinned"), F.count_if(F.col("snoozed_until").isNotNull()).alias("snoozed"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"), F.max("modified_at").alias("last_modified"))

    def export(self, path: str, kind: str = "json") -> None:
        readers.write_results(self.table("documents").where("active"), path, kind)

    def backup(self, path: str) -> None:
        """A copy of the current version of every table, itself a vault."""
        copy = Vault(self.spark, path, self.now)
        for name in SCHEMAS:
            if self._latest(name):
                copy.commit(name, self.table(name))
