"""Queries over lifecycle, recall, usage, graph and facts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import time as Time
from ..operators import entity, graph, lifecycle
from ..sources.tables import NOW, Tables, sql

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    """Register a function of the model's tables under a name, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def r6(c):
    return F.round(c, 6)


NOW_S = f"epoch(TIMESTAMP '{NOW}')"


@query("collection_stats", "docs", "SELECT collection, count(*) AS doc_count, count(*) FILTER (active) AS active_count, max(epoch(modified_at))::BIGINT AS last_modified FROM docs GROUP BY collection")
def collection_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("collection").agg(F.count("*").alias("doc_count"), F.count_if("active").alias("active_count"), F.max(F.unix_timestamp("modified_at")).alias("last_modified"))


@query("type_histogram", "docs", "SELECT content_type, count(*) AS n FROM docs WHERE active GROUP BY content_type")
def type_histogram(t: Tables) -> DataFrame:
    return t.documents.where("active").groupBy("content_type").agg(F.count("*").alias("n"))


@query(
    "memory_stats", "docs",
    f"""SELECT collection, count(*) AS total, count(*) FILTER (pinned) AS pinned, count(*) FILTER (invalidated) AS invalidated, count(*) FILTER (access_count = 0) AS never_accessed,
    count(*) FILTER (quality_score >= 0.7) AS good, count(*) FILTER (confidence < 0.4) AS doubtful, count(*) FILTER (content_type IN ('decision', 'deductive', 'preference', 'hub')) AS durable,
    count(*) FILTER ({NOW_S} - epoch(modified_at) <= 30 * 86400) AS recent, round(avg(access_count), 6) AS avg_access, round(avg(quality_score), 6) AS avg_quality, sum(revision_count - 1)::BIGINT AS revisions,
    sum(duplicate_count - 1)::BIGINT AS duplicates, max(length(body)) AS longest, min(epoch(modified_at))::BIGINT AS oldest FROM docs WHERE active GROUP BY collection""",
)
def memory_stats(t: Tables) -> DataFrame:
    return t.documents.where("active").groupBy("collection").agg(
        F.count("*").alias("total"), F.count_if("pinned").alias("pinned"), F.count_if("invalidated").alias("invalidated"), F.count_if(F.col("access_count") == 0).alias("never_accessed"),
        F.count_if(F.col("quality_score") >= 0.7).alias("good"), F.count_if(F.col("confidence") < 0.4).alias("doubtful"), F.count_if(F.col("content_type").isin("decision", "deductive", "preference", "hub")).alias("durable"),
        F.count_if(Time.age_days(F.col("modified_at"), NOW) <= 30).alias("recent"), r6(F.avg("access_count")).alias("avg_access"), r6(F.avg("quality_score")).alias("avg_quality"),
        F.sum(F.col("revision_count") - 1).alias("revisions"), F.sum(F.col("duplicate_count") - 1).alias("duplicates"), F.max(F.length("body")).cast("long").alias("longest"), F.min(F.unix_timestamp("modified_at")).alias("oldest"),
    )


@query("index_health", "docs vectors", f"SELECT count(*) FILTER (v.doc_id IS NULL) AS needs_embedding, count(*) AS total, floor(({NOW_S} - max(epoch(modified_at))) / 86400)::BIGINT AS days_stale FROM docs LEFT JOIN vectors v ON v.doc_id = id WHERE active")
def index_health(t: Tables) -> DataFrame:
    d = t.documents.where("active").join(t.vectors.select("doc_id"), F.col("id") == F.col("doc_id"), "left")
    return d.agg(F.count_if(F.col("doc_id").isNull()).alias("needs_embedding"), F.count("*").alias("total"), F.floor(Time.age_days(F.max("modified_at"), NOW)).alias("days_stale"))


@query("missing_vectors", "docs vectors", "SELECT hash, min(collection || '/' || path) AS first_path, count(*) AS n FROM docs WHERE active AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.doc_id = docs.id) GROUP BY hash")
def missing_vectors(t: Tables) -> DataFrame:
    d = t.documents.where("active").join(t.vectors, F.col("id") == F.col("doc_id"), "left_anti")
    return d.groupBy("hash").agg(F.min(F.concat_ws("/", "collection", "path")).alias("first_path"), F.count("*").alias("n"))


@query("stale_vectors", "docs vectors", "SELECT doc_id, label FROM vectors WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.id = vectors.doc_id AND active AND NOT invalidated)")
def stale_vectors(t: Tables) -> DataFrame:
    return t.vectors.join(t.documents.where("active and not invalidated"), F.col("id") == F.col("doc_id"), "left_anti").select("doc_id", "label")


@query("vector_consistency", "docs vectors", "SELECT (SELECT count(*) FROM docs WHERE id NOT IN (SELECT doc_id FROM vectors)) AS only_documents, (SELECT count(*) FROM vectors WHERE doc_id NOT IN (SELECT id FROM docs)) AS only_vectors")
def vector_consistency(t: Tables) -> DataFrame:
    both = t.documents.select("id", F.lit(1).alias("d")).join(t.vectors.select(F.col("doc_id").alias("id"), F.lit(1).alias("v")), "id", "full")
    return both.agg(F.count_if(F.col("v").isNull()).alias("only_documents"), F.count_if(F.col("d").isNull()).alias("only_vectors"))


@query("eligible_documents", "docs", "SELECT id, collection FROM docs WHERE active AND NOT invalidated AND collection IN ('src0', 'src1', 'src2', 'src3') AND collection NOT IN ('src3') AND modified_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-09-30'")
def eligible_documents(t: Tables) -> DataFrame:
    return t.documents.where(lifecycle.eligible(["src0", "src1", "src2", "src3"], ["src3"], "2024-03-01", "2024-09-30")).select("id", "collection")


@query("recent_documents", "docs", "SELECT id, substring(hash, 1, 6) AS docid, title FROM docs WHERE active ORDER BY modified_at DESC, id DESC LIMIT 20")
def recent_documents(t: Tables) -> DataFrame:
    return t.documents.where("active").orderBy(F.desc("modified_at"), F.desc("id")).limit(20).select("id", T.docid(F.col("hash")).alias("docid"), "title")


@query("newest_by_type", "docs", "SELECT content_type, id, r AS rank FROM (SELECT content_type, id, row_number() OVER (PARTITION BY content_type ORDER BY modified_at DESC, id DESC) AS r FROM docs WHERE active) WHERE r <= 10")
def newest_by_type(t: Tables) -> DataFrame:
    w = Window.partitionBy("content_type").orderBy(F.desc("modified_at"), F.desc("id"))
    return t.documents.where("active").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("content_type", "id", "rank")


@query(
    "archive_candidates", "docs",
    f"""SELECT id, content_type FROM (SELECT *, CASE content_type WHEN 'handoff' THEN 60 WHEN 'progress' THEN 30 WHEN 'decision' THEN NULL WHEN 'preference' THEN NULL ELSE 90 END AS lim FROM docs)
    WHERE active AND NOT pinned AND lim IS NOT NULL AND ({NOW_S} - epoch(modified_at)) / 86400 > lim AND coalesce(({NOW_S} - epoch(last_accessed_at)) / 86400 > lim, true)""",
)
def archive_candidates(t: Tables) -> DataFrame:
    return lifecycle.archive_candidates(t.documents, NOW, 90, {"handoff": 60, "progress": 30, "decision": None, "preference": None}).select("id", "content_type")


@query("archive_plan", "docs", f"SELECT content_type, count(*) AS n, sum(length(body))::BIGINT AS chars FROM docs WHERE active AND NOT pinned AND ({NOW_S} - epoch(modified_at)) / 86400 > 90 AND ({NOW_S} - epoch(last_accessed_at)) / 86400 > 90 GROUP BY content_type")
def archive_plan(t: Tables) -> DataFrame:
    return lifecycle.archive_candidates(t.documents, NOW, 90, {}).groupBy("content_type").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query("copies", "docs", r"SELECT sha256(trim(regexp_replace(lower(body), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS normalized_hash, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM docs GROUP BY 1 HAVING count(*) > 1")
def copies(t: Tables) -> DataFrame:
    return lifecycle.copies(t.documents)


@query("new_contents", "docs", "SELECT hash, min(id) AS id FROM docs WHERE hash NOT IN (SELECT hash FROM docs WHERE collection = 'src0') GROUP BY hash")
def new_contents(t: Tables) -> DataFrame:
    stored = t.documents.where("collection = 'src0'").select("hash").distinct()
    return t.documents.join(stored, "hash", "left_anti").groupBy("hash").agg(F.min("id").alias("id"))


@query("upsert_documents", "docs", "SELECT d.id, coalesce(n.title, d.title) AS title, d.revision_count + CASE WHEN n.id IS NULL THEN 0 ELSE 1 END AS revision_count FROM docs d LEFT JOIN (SELECT id, 'new ' || title AS title FROM docs WHERE content_type = 'note') n ON n.id = d.id")
def upsert_documents(t: Tables) -> DataFrame:
    old = t.documents.select("id", "title", "revision_count")
    new = t.documents.where("content_type = 'note'").select("id", F.concat(F.lit("new "), "title").alias("title"), (F.col("revision_count") + 1).alias("revision_count"))
    return lifecycle.upsert(old, new, ["id"])


@query("patch_metadata", "docs", "SELECT id, CASE WHEN invalidated THEN 0.2::DOUBLE ELSE confidence END AS confidence, CASE WHEN pinned THEN 'hub' ELSE content_type END AS content_type FROM docs")
def patch_metadata(t: Tables) -> DataFrame:
    changes = t.documents.where("invalidated or pinned").select("id", F.when(F.col("invalidated"), F.lit(0.2)).alias("confidence"), F.when(F.col("pinned"), F.lit("hub")).alias("content_type"))
    return lifecycle.patch(t.documents.select("id", "confidence", "content_type"), changes, "id")


@query("access_bump", "docs recall", "SELECT d.id, access_count + coalesce(n, 0) AS access_count FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM recall WHERE was_referenced GROUP BY doc_id) r ON r.doc_id = d.id")
def access_bump(t: Tables) -> DataFrame:
    bumps = t.recall_events.where("was_referenced").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t.documents.join(bumps, F.col("id") == F.col("doc_id"), "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query(
    "recall_stats", "recall",
    """SELECT doc_id, count(*) AS recalls, count(DISTINCT query_hash) AS unique_queries, count(DISTINCT surfaced_at::DATE) AS recall_days, round(sum(search_score), 6) AS total_score, round(max(search_score), 6) AS best_score,
    count(*) FILTER (was_referenced) AS referenced, count(*) FILTER (NOT was_referenced) AS negative, round(least(1.0, greatest(count(DISTINCT query_hash), count(DISTINCT surfaced_at::DATE)) / 5), 6) AS diversity,
    round(CASE count(DISTINCT surfaced_at::DATE) WHEN 0 THEN 0 WHEN 1 THEN 0.2 ELSE 0.55 * least(1.0, ln(count(DISTINCT surfaced_at::DATE)) / ln(5)) + 0.45 * least(1.0, date_diff('day', min(surfaced_at)::DATE, max(surfaced_at)::DATE) / 7) END, 6) AS spacing
    FROM recall GROUP BY doc_id""",
)
def recall_stats(t: Tables) -> DataFrame:
    day = F.to_date("surfaced_at")
    g = t.recall_events.groupBy("doc_id").agg(
        F.count("*").alias("recalls"), F.countDistinct("query_hash").alias("unique_queries"), F.countDistinct(day).alias("recall_days"), r6(F.sum("search_score")).alias("total_score"), r6(F.max("search_score")).alias("best_score"),
        F.count_if("was_referenced").alias("referenced"), F.count_if(~F.col("was_referenced")).alias("negative"), F.datediff(F.max(day), F.min(day)).alias("span"),
    )
    return g.withColumn("diversity", r6(S.diversity(F.col("unique_queries"), F.col("recall_days")))).withColumn("spacing", r6(S.spacing(F.col("recall_days"), F.col("span")))).drop("span")


@query("latest_recall", "recall", "SELECT session_id, doc_id, id, round(search_score, 6) AS search_score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id ORDER BY surfaced_at DESC, id DESC) AS r FROM recall) WHERE r = 1")
def latest_recall(t: Tables) -> DataFrame:
    best = t.recall_events.groupBy("session_id", "doc_id").agg(F.max_by(F.struct("id", "search_score"), F.struct("surfaced_at", "id")).alias("e"))
    return best.select("session_id", "doc_id", "e.id", r6(F.col("e.search_score")).alias("search_score"))


@query("recall_writer", "docs recall", "SELECT r.id, d.path, r.query_hash FROM recall r JOIN docs d ON d.id = r.doc_id AND d.active")
def recall_writer(t: Tables) -> DataFrame:
    d = t.documents.where("active").select(F.col("id").alias("doc_id"), "path")
    return t.recall_events.join(d, "doc_id").select("id", "path", "query_hash")


@query("utility_signals", "recall", "SELECT doc_id, count(*) AS surfaced, count(*) FILTER (was_referenced) AS referenced, max(epoch_us(surfaced_at)) FILTER (was_referenced) AS last_referenced, round(count(*) FILTER (was_referenced) / count(*), 6) AS rate FROM recall GROUP BY doc_id")
def utility_signals(t: Tables) -> DataFrame:
    return t.recall_events.groupBy("doc_id").agg(
        F.count("*").alias("surfaced"), F.count_if("was_referenced").alias("referenced"), F.max(F.when(F.col("was_referenced"), F.unix_micros(F.col("surfaced_at").cast("timestamp")))).alias("last_referenced"), r6(F.count_if("was_referenced") / F.count("*")).alias("rate")
    )


@query("sessions", "recall", "SELECT session_id, count(*) AS n_events, min(epoch_us(surfaced_at)) AS started, max(epoch_us(surfaced_at)) AS ended, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM recall GROUP BY session_id")
def sessions(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("surfaced_at").cast("timestamp"))
    return t.recall_events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.min(us).alias("started"), F.max(us).alias("ended"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("usage_budget", "recall", "SELECT session_id, sum(ceil(length(query_hash) / 4))::BIGINT AS tokens, max(turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY surfaced_at, id) - 1 AS turn FROM recall) GROUP BY session_id")
def usage_budget(t: Tables) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("surfaced_at", "id")) - 1
    return t.recall_events.withColumn("turn", turn).groupBy("session_id").agg(F.sum(T.token_estimate(F.col("query_hash"))).alias("tokens"), F.max("turn").cast("long").alias("turns"))


@query("prompt_dedupe", "recall", "SELECT id, coalesce(epoch(surfaced_at) - lag(epoch(surfaced_at)) OVER (PARTITION BY event_type, doc_id ORDER BY surfaced_at, id) < 600, false) AS duplicate FROM recall")
def prompt_dedupe(t: Tables) -> DataFrame:
    e = t.recall_events
    last = F.lag(F.unix_micros(F.col("surfaced_at").cast("timestamp"))).over(Window.partitionBy("event_type", "doc_id").orderBy("surfaced_at", "id"))
    return e.select("id", F.coalesce((F.unix_micros(F.col("surfaced_at").cast("timestamp")) - last) < 600_000_000, F.lit(False)).alias("duplicate"))


@query(
    "save_dedupe", "recall",
    """WITH RECURSIVE ordered AS (SELECT id, event_type, doc_id, floor(epoch(surfaced_at))::BIGINT AS secs, row_number() OVER (PARTITION BY event_type, doc_id ORDER BY floor(epoch(surfaced_at)), id) AS r FROM recall),
    fold AS (SELECT id, event_type, doc_id, secs, r, secs AS since, id AS survivor FROM ordered WHERE r = 1
      UNION ALL SELECT o.id, o.event_type, o.doc_id, o.secs, o.r, CASE WHEN o.secs - f.since >= 86400 THEN o.secs ELSE f.since END, CASE WHEN o.secs - f.since >= 86400 THEN o.id ELSE f.survivor END
      FROM fold f JOIN ordered o ON o.event_type = f.event_type AND o.doc_id = f.doc_id AND o.r = f.r + 1)
    SELECT id, survivor FROM fold""",
)
def save_dedupe(t: Tables) -> DataFrame:
    saves = t.recall_events.select("id", F.floor(F.unix_micros(F.col("surfaced_at").cast("timestamp")) / 1_000_000).alias("at"), "event_type", "doc_id")
    return lifecycle.fixed_windows(saves, ["event_type", "doc_id"], 86400).select("id", "survivor")


@query(
    "confidence_erosion", "recall",
    """WITH RECURSIVE ordered AS (SELECT id, doc_id, CASE event_type WHEN 'error' THEN 'contradiction' WHEN 'view' THEN 'update' ELSE 'same' END AS rel, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS r FROM recall),
    fold AS (SELECT id, doc_id, r, CASE rel WHEN 'contradiction' THEN 0.75 WHEN 'update' THEN 0.85 ELSE 1.0 END::DOUBLE AS c FROM ordered WHERE r = 1
      UNION ALL SELECT o.id, o.doc_id, o.r, CASE o.rel WHEN 'contradiction' THEN greatest(0.2::DOUBLE, c - 0.25::DOUBLE) WHEN 'update' THEN greatest(0.3::DOUBLE, c - 0.15::DOUBLE) ELSE c END FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
    SELECT doc_id, id, round(c, 6) AS confidence FROM fold""",
)
def confidence_erosion(t: Tables) -> DataFrame:
    rel = F.when(F.col("event_type") == "error", "contradiction").when(F.col("event_type") == "view", "update").otherwise("same")
    return lifecycle.erosion(t.recall_events.withColumn("rel", rel), "doc_id", ["id"], "rel", 1.0).select("doc_id", "id", r6(F.col("confidence")).alias("confidence"))


@query("gap_sessions", "recall", "SELECT doc_id, session, count(*) AS n, min(id) AS first_id FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY surfaced_at, id) AS session FROM (SELECT *, CASE WHEN epoch_us(surfaced_at) - lag(epoch_us(surfaced_at)) OVER (PARTITION BY doc_id ORDER BY surfaced_at, id) <= 21600000000 THEN 0 ELSE 1 END AS begins FROM recall)) GROUP BY doc_id, session")
def gap_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("surfaced_at", "id")
    us = F.unix_micros(F.col("surfaced_at").cast("timestamp"))
    e = t.recall_events.withColumn("begins", F.when(us - F.lag(us).over(w) <= 21_600_000_000, 0).otherwise(1))
    return e.withColumn("session", F.sum("begins").over(w)).groupBy("doc_id", "session").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("relation_max", "recall", "SELECT doc_id AS source_id, try_cast(query_hash AS BIGINT) AS target_id, event_type AS relation_type, round(max(search_score), 6) AS weight FROM recall WHERE doc_id <> try_cast(query_hash AS BIGINT) GROUP BY ALL")
def relation_max(t: Tables) -> DataFrame:
    edges = t.recall_events.select(F.col("doc_id").alias("source_id"), F.expr("try_cast(query_hash AS BIGINT)").alias("target_id"), F.col("event_type").alias("relation_type"), F.col("search_score").alias("weight"))
    return graph.merged(edges, "max").withColumn("weight", r6(F.col("weight")))


@query("relation_sum", "recall", "SELECT doc_id AS source_id, try_cast(query_hash AS BIGINT) AS target_id, event_type AS relation_type, count(*)::DOUBLE AS weight FROM recall WHERE doc_id <> try_cast(query_hash AS BIGINT) GROUP BY ALL")
def relation_sum(t: Tables) -> DataFrame:
    edges = t.recall_events.select(F.col("doc_id").alias("source_id"), F.expr("try_cast(query_hash AS BIGINT)").alias("target_id"), F.col("event_type").alias("relation_type"), F.lit(1.0).alias("weight"))
    return graph.merged(edges, "sum")


@query("co_activations", "baskets", "SELECT a.item AS a, b.item AS b, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL")
def co_activations(t: Tables) -> DataFrame:
    return graph.pair_counts(t.baskets)


@query(
    "co_activation_partners", "baskets",
    "WITH p AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL), s AS (SELECT a AS item, b AS partner, n FROM p UNION ALL SELECT b, a, n FROM p) SELECT item, partner, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) AS r FROM s) WHERE r <= 5",
)
def co_activation_partners(t: Tables) -> DataFrame:
    p = graph.pair_counts(t.baskets)
    sides = p.select(F.col("a").alias("item"), F.col("b").alias("partner"), "n").unionByName(p.select(F.col("b").alias("item"), F.col("a").alias("partner"), "n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "partner")
    return sides.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query("temporal_backbone", "docs", "SELECT id AS source_id, target_id FROM (SELECT id, lead(id) OVER (ORDER BY modified_at, id) AS target_id FROM docs) WHERE target_id IS NOT NULL")
def temporal_backbone(t: Tables) -> DataFrame:
    return graph.temporal_edges(t.documents)


@query("temporal_backbone_by_collection", "docs", "SELECT id AS source_id, target_id FROM (SELECT id, lead(id) OVER (PARTITION BY collection ORDER BY modified_at, id) AS target_id FROM docs) WHERE target_id IS NOT NULL")
def temporal_backbone_by_collection(t: Tables) -> DataFrame:
    return graph.temporal_edges(t.documents, "collection")


@query("timeline", "docs", "SELECT id, lag(id, 1) OVER w AS before_1, lag(id, 2) OVER w AS before_2, lead(id, 1) OVER w AS after_1, lead(id, 2) OVER w AS after_2, count(*) OVER (PARTITION BY collection) AS total FROM docs WHERE active WINDOW w AS (PARTITION BY collection ORDER BY modified_at, id)")
def timeline(t: Tables) -> DataFrame:
    w = Window.partitionBy("collection").orderBy("modified_at", "id")
    return t.documents.where("active").select("id", F.lag("id", 1).over(w).alias("before_1"), F.lag("id", 2).over(w).alias("before_2"), F.lead("id", 1).over(w).alias("after_1"), F.lead("id", 2).over(w).alias("after_2"), F.count("*").over(Window.partitionBy("collection")).alias("total"))


@query("median_length", "docs", "SELECT content_type, round(median(length(body)), 6) AS median, list_sort(list(length(body)))[ceil(0.95 * count(*))::INT]::DOUBLE AS p95 FROM docs GROUP BY content_type")
def median_length(t: Tables) -> DataFrame:
    n = F.length("body")
    return t.documents.groupBy("content_type").agg(r6(F.percentile(n, 0.5)).alias("median"), F.expr("round(cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY length(body)) AS double), 6)").alias("p95"))


@query("facts_as_of", "triples", "SELECT triple_id, subject, object FROM triples WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1996-06-30')")
def facts_as_of(t: Tables) -> DataFrame:
    at = F.to_timestamp(F.lit("1996-06-30"))
    return t.triples.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))).select("triple_id", "subject", "object")


@query("fact_stats", "triples", "SELECT count(*) AS total, count(*) FILTER (valid_to IS NULL) AS open, count(*) FILTER (valid_to IS NOT NULL) AS expired, count(DISTINCT predicate || object) AS kinds FROM triples")
def fact_stats(t: Tables) -> DataFrame:
    return t.triples.agg(F.count("*").alias("total"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.countDistinct(F.concat("predicate", "object")).alias("kinds"))


@query("evidence_top", "triples", "SELECT subject, object, triple_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY valid_from DESC, triple_id DESC) AS r FROM triples) WHERE r <= 3")
def evidence_top(t: Tables) -> DataFrame:
    w = Window.partitionBy("subject", "object").orderBy(F.desc("valid_from"), F.desc("triple_id"))
    return t.triples.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("subject", "object", "triple_id", "rank")


@query("strongest_witness", "triples", "SELECT subject, object, max_by(triple_id, struct_pack(c := confidence, t := triple_id)) AS triple_id, round(max(confidence), 6) AS confidence, count(*) AS n FROM triples GROUP BY subject, object")
def strongest_witness(t: Tables) -> DataFrame:
    return t.triples.groupBy("subject", "object").agg(F.max_by("triple_id", F.struct("confidence", "triple_id")).alias("triple_id"), r6(F.max("confidence")).alias("confidence"), F.count("*").alias("n"))


@query("fact_changes", "triples", "SELECT subject, triple_id, object, previous FROM (SELECT *, lag(object) OVER (PARTITION BY subject ORDER BY valid_from, triple_id) AS previous FROM triples) WHERE previous IS DISTINCT FROM object")
def fact_changes(t: Tables) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("valid_from", "triple_id")
    return t.triples.withColumn("previous", F.lag("object").over(w)).where(~F.col("previous").eqNullSafe(F.col("object"))).select("subject", "triple_id", "object", "previous")


@query("entity_idf", "mentions", "SELECT entity, count(*) AS df, round(ln(((SELECT count(DISTINCT doc_id) FROM mentions) + 1) / (count(*) + 1)), 6) AS idf FROM mentions GROUP BY entity")
def entity_idf(t: Tables) -> DataFrame:
    return entity.idf(t.mentions).withColumn("idf", r6(F.col("idf")))


@query("entity_cooccurrence", "mentions", "SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL")
def entity_cooccurrence(t: Tables) -> DataFrame:
    return graph.pair_counts(t.mentions, "doc_id", "entity")


@query(
    "entity_neighbours", "mentions",
    "WITH p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL), s AS (SELECT a AS seed, b AS entity, n FROM p UNION ALL SELECT b, a, n FROM p) SELECT entity, max(n) AS n FROM s WHERE seed LIKE 'type:%' GROUP BY entity",
)
def entity_neighbours(t: Tables) -> DataFrame:
    seeds = t.mentions.where("entity LIKE 'type:%'").select(F.col("entity").alias("seed")).distinct()
    return entity.neighbours(seeds, graph.pair_counts(t.mentions, "doc_id", "entity"))


@query(
    "entity_expansion", "mentions",
    """WITH p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL),
    s AS (SELECT a AS seed, b AS entity, n FROM p UNION ALL SELECT b, a, n FROM p), seeds AS (SELECT min(entity) AS seed FROM mentions),
    near AS (SELECT entity, max(n) AS n FROM s JOIN seeds USING (seed) GROUP BY entity), i AS (SELECT entity, ln(((SELECT count(DISTINCT doc_id) FROM mentions) + 1) / (count(*) + 1)) AS idf FROM mentions GROUP BY entity),
    best AS (SELECT entity, least(1.0, ln(1 + n) / 5) * least(1.0, greatest(0.0, idf / 3)) AS score FROM near JOIN i USING (entity) ORDER BY 2 DESC, 1 LIMIT 30),
    docs AS (SELECT doc_id, score, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS r FROM mentions JOIN best USING (entity))
    SELECT doc_id, round(max(score), 6) AS score FROM docs WHERE r <= 10 AND doc_id NOT IN (SELECT doc_id FROM mentions JOIN seeds ON entity = seed) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 20""",
)
def entity_expansion(t: Tables) -> DataFrame:
    seeds = t.mentions.agg(F.min("entity").alias("seed"))
    return entity.expansion(seeds, graph.pair_counts(t.mentions, "doc_id", "entity"), t.mentions, 30, 10, 20).withColumn("score", r6(F.col("score")))


@query("exchange_groups", "", "SELECT conv_id, g AS exchange, min(turn) AS first_turn, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn) AS body FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role <> 'system') WHERE g > 0 GROUP BY conv_id, g HAVING sum(length(text)) >= 30")
def exchange_groups(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.where("role <> 'system'").withColumn("exchange", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("exchange > 0")
    g = c.groupBy("conv_id", "exchange").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    return g.where("n >= 30").select("conv_id", "exchange", "first_turn", "turns", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))


@query("transcript_tail", "", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 3")
def transcript_tail(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.conversations.where(F.col("role").isin("user", "assistant")).withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn", "role")


@query("transcript_priorities", "", "SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = fu THEN 0 WHEN role = 'assistant' AND turn = la THEN 1 WHEN role = 'tool' THEN 2 WHEN role = 'system' THEN 4 ELSE 3 END AS priority FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS fu, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la FROM conversations)")
def transcript_priorities(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    first, last = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)
    p = F.when((F.col("role") == "user") & (F.col("turn") == first), 0).when((F.col("role") == "assistant") & (F.col("turn") == last), 1).when(F.col("role") == "tool", 2).when(F.col("role") == "system", 4).otherwise(3)
    return t.conversations.select("conv_id", "turn", p.alias("priority"))


@query("token_budget", "docs", "SELECT collection, id FROM (SELECT collection, id, row_number() OVER w AS r, sum(ceil(length(body) / 4)) OVER (PARTITION BY collection ORDER BY modified_at DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM docs WHERE active WINDOW w AS (PARTITION BY collection ORDER BY modified_at DESC, id)) WHERE r = 1 OR s <= 2000")
def token_budget(t: Tables) -> DataFrame:
    from ..operators import fusion

    d = t.documents.where("active").withColumn("tokens", T.token_estimate(F.col("body")))
    return fusion.within_budget(d, "collection", [F.desc("modified_at"), "id"], "tokens", 2000).select("collection", "id")


@query("observation_trend", "docs", f"SELECT id, CASE WHEN ({NOW_S} - epoch(modified_at)) / 86400 < 7 THEN 'NEW' WHEN ({NOW_S} - epoch(last_accessed_at)) / 86400 > 60 THEN 'STALE' WHEN ({NOW_S} - epoch(last_accessed_at)) / 86400 > 30 THEN 'WEAKENING' WHEN revision_count >= 4 AND ({NOW_S} - epoch(last_accessed_at)) / 86400 < 14 THEN 'STRENGTHENING' ELSE 'STABLE' END AS trend FROM docs")
def observation_trend(t: Tables) -> DataFrame:
    return t.documents.select("id", lifecycle.trend(F.col("revision_count"), Time.age_days(F.col("modified_at"), NOW), Time.age_days(F.col("last_accessed_at"), NOW)).alias("trend"))


@query("audit_retention", "recall", "SELECT id FROM (SELECT id, surfaced_at, row_number() OVER (ORDER BY surfaced_at DESC, id DESC) AS r, max(surfaced_at) OVER () AS last FROM recall) WHERE surfaced_at < last - INTERVAL 20 DAY OR r > 5000")
def audit_retention(t: Tables) -> DataFrame:
    e = t.recall_events.select("id", "surfaced_at")
    last = e.agg(F.max("surfaced_at").alias("last"))
    newest = e.orderBy(F.desc("surfaced_at"), F.desc("id")).limit(5000).select("id")
    old = e.crossJoin(F.broadcast(last)).where("surfaced_at < last - INTERVAL 20 DAYS").select("id")  # last is one row
    return e.select("id").join(newest, "id", "left_anti").unionByName(old).distinct()


@query("theme_counts", "", r"WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram, n FROM (SELECT w, unnest([2, 3]) AS n, w AS x FROM w), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)) SELECT gram, n, count(*) AS c FROM g GROUP BY gram, n HAVING count(*) >= 3 ORDER BY c DESC, n DESC, gram LIMIT 20")
def theme_counts(t: Tables) -> DataFrame:
    w = t.raw("benchmark").select(T.tokens(F.col("text")).alias("w"))

    def grams_of(n: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", F.slice("w", i, n)))
        return w.where(F.size("w") >= n).select(F.explode(each).alias("gram"), F.lit(n).alias("n"))

    grams = [grams_of(2), grams_of(3)]
    return grams[0].unionByName(grams[1]).groupBy("gram", "n").agg(F.count("*").alias("c")).where("c >= 3").orderBy(F.desc("c"), F.desc("n"), "gram").limit(20)
