"""Queries of lookup, mutation, facts over time, caches and upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as Time
from ..operators import fusion, graph, lifecycle, proximity
from ..sources.shared import few
from ..sources.tables import NOW, Tables, sql
from . import search as searching
from . import textual

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("fuzzy_paths", "docs", "WITH w AS (SELECT DISTINCT collection, 'doc-' || id || '.md' AS name FROM docs), t AS (SELECT collection, min(name) AS wanted FROM w GROUP BY 1) SELECT collection, wanted, name, d AS distance, r AS rank FROM (SELECT collection, wanted, name, levenshtein(wanted, name) AS d, row_number() OVER (PARTITION BY collection ORDER BY levenshtein(wanted, name), name) AS r FROM t JOIN w USING (collection) WHERE levenshtein(wanted, name) BETWEEN 1 AND 3) WHERE r <= 5")
def fuzzy_paths(t: Tables) -> DataFrame:
    """What was meant by a name that isn't there: names within an edit distance of 3."""
    w = t.documents.select("collection", F.concat(F.lit("doc-"), F.col("id").cast("string"), F.lit(".md")).alias("name")).distinct()
    wanted = w.groupBy("collection").agg(F.min("name").alias("wanted"))
    near = w.join(wanted, "collection").withColumn("distance", F.levenshtein("wanted", "name", 3)).where("distance between 1 and 3")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("collection").orderBy("distance", "name"))).where("rank <= 5")


@query("docid_lookup", "docs", "SELECT substring(hash, 1, 6) AS docid, count(*) AS n, min(id) AS id FROM docs GROUP BY 1")
def docid_lookup(t: Tables) -> DataFrame:
    return t.documents.groupBy(T.docid(F.col("hash")).alias("docid")).agg(F.count("*").alias("n"), F.min("id").alias("id"))


@query("glob_matches", "", r"SELECT page_id FROM pages WHERE regexp_matches(url, '^[^/]*//[^/]*/en/[^/]*\.html$')")
def glob_matches(t: Tables) -> DataFrame:
    """The glob ``*//*/en/*.html``: a star doesn't cross a slash."""
    return t.raw("pages").where(F.col("url").rlike(r"^[^/]*//[^/]*/en/[^/]*\.html$")).select("page_id")


@query("path_contexts", "", "WITH c(prefix, context) AS (VALUES ('http', 'any'), ('https://', 'secure'), ('https://www.', 'www')), m AS (SELECT page_id, context, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS r FROM pages JOIN c ON starts_with(url, prefix)) SELECT p.page_id, coalesce(m.context, 'global') AS context FROM pages p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1")
def path_contexts(t: Tables) -> DataFrame:
    """The context of the longest prefix that fits, else the global one."""
    found = F.lit("global")
    for prefix, context in (("http", "any"), ("https://", "secure"), ("https://www.", "www")):
        found = F.when(F.startswith("url", F.lit(prefix)), context).otherwise(found)
    return t.raw("pages").select("page_id", found.alias("context"))


@query("noise_filter", "", r"SELECT conv_id, turn, length(trim(text)) < 10 OR regexp_matches(text, '(?i)i (don.t|do not) have|no results|cannot find') AS noise, regexp_matches(text, '(?i)remember|recall|last time|previously') OR NOT (length(trim(text)) < 15 OR regexp_matches(text, '(?i)^(hi|hello|thanks|ok|yes|no)[ .!]*$') OR starts_with(text, '/')) AS retrieve FROM conversations")
def noise_filter(t: Tables) -> DataFrame:
    """Which turns are noise, and for which a memory is looked up."""
    text = F.col("text")
    noise = (F.length(F.trim(text)) < 10) | text.rlike("(?i)i (don.t|do not) have|no results|cannot find")
    skip = (F.length(F.trim(text)) < 15) | text.rlike("(?i)^(hi|hello|thanks|ok|yes|no)[ .!]*$") | F.startswith(text, F.lit("/"))
    return t.conversations.select("conv_id", "turn", noise.alias("noise"), (text.rlike("(?i)remember|recall|last time|previously") | ~skip).alias("retrieve"))


@query("snoozed", "docs", f"SELECT id, last_accessed_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS snoozed FROM docs WHERE active")
def snoozed(t: Tables) -> DataFrame:
    return t.documents.where("active").select("id", (F.col("last_accessed_at") > F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 30 DAYS")).alias("snoozed"))


@query("orphan_contents", "docs", "SELECT DISTINCT hash FROM docs WHERE hash NOT IN (SELECT hash FROM docs WHERE active AND NOT invalidated)")
def orphan_contents(t: Tables) -> DataFrame:
    return t.documents.select("hash").distinct().join(t.documents.where("active and not invalidated").select("hash"), "hash", "left_anti")


@query("embed_states", "docs vectors", "SELECT CASE WHEN v.doc_id IS NOT NULL THEN 'synced' WHEN NOT active THEN 'skipped' WHEN revision_count >= 3 THEN 'failed' ELSE 'pending' END AS state, count(*) AS n FROM docs LEFT JOIN vectors v ON v.doc_id = id GROUP BY 1")
def embed_states(t: Tables) -> DataFrame:
    d = t.documents.join(t.vectors.select("doc_id"), F.col("id") == F.col("doc_id"), "left")
    state = F.when(F.col("doc_id").isNotNull(), "synced").when(~F.col("active"), "skipped").when(F.col("revision_count") >= 3, "failed").otherwise("pending")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("cache_eviction", "recall", "SELECT query_hash, id FROM (SELECT query_hash, id, row_number() OVER (ORDER BY surfaced_at DESC, id DESC) AS r FROM (SELECT query_hash, surfaced_at, id, row_number() OVER (PARTITION BY query_hash ORDER BY surfaced_at DESC, id DESC) AS k FROM recall) WHERE k = 1) WHERE r <= 50")
def cache_eviction(t: Tables) -> DataFrame:
    """A cache keyed by query: the newest entry of each key, of the 50 newest keys."""
    newest = t.recall_events.groupBy("query_hash").agg(F.max(F.struct("surfaced_at", "id")).alias("e"))
    return newest.orderBy(F.desc("e")).limit(50).select("query_hash", "e.id")


@query("facts_open", "triples", "SELECT subject, predicate, object, count(*) AS evidence, min(epoch(valid_from))::BIGINT AS since FROM triples WHERE valid_to IS NULL GROUP BY ALL")
def facts_open(t: Tables) -> DataFrame:
    """Facts that hold now, each once, with how many rows bear them out."""
    return t.triples.where("valid_to is null").groupBy("subject", "predicate", "object").agg(F.count("*").alias("evidence"), F.min(F.unix_timestamp(F.col("valid_from").cast("timestamp"))).alias("since"))


@query("facts_merged", "triples", "SELECT subject, object, g AS run, min(epoch(valid_from))::BIGINT AS first, CASE WHEN count(*) = count(valid_to) THEN max(epoch(valid_to))::BIGINT END AS last, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY valid_from, triple_id) AS g FROM (SELECT *, CASE WHEN lag(object) OVER (PARTITION BY subject ORDER BY valid_from, triple_id) = object THEN 0 ELSE 1 END AS c FROM triples)) GROUP BY subject, object, g")
def facts_merged(t: Tables) -> DataFrame:
    """Adjacent validity of equal facts as one interval."""
    w = Window.partitionBy("subject").orderBy("valid_from", "triple_id")
    d = t.triples.withColumn("c", F.when(F.lag("object").over(w) == F.col("object"), 0).otherwise(1)).withColumn("run", F.sum("c").over(w))
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return d.groupBy("subject", "object", "run").agg(F.min(s("valid_from")).alias("first"), F.when(F.count("*") == F.count("valid_to"), F.max(s("valid_to"))).alias("last"), F.count("*").alias("n"))


@query("facts_block", "triples", "SELECT subject, object FROM (SELECT subject, object, sum(ceil((length(object) + 10) / 4)) OVER (PARTITION BY subject ORDER BY valid_from DESC, triple_id DESC) AS s, row_number() OVER (PARTITION BY subject ORDER BY valid_from DESC, triple_id DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY valid_from DESC, triple_id DESC) AS k FROM triples) WHERE k = 1) WHERE r = 1 OR s <= 6")
def facts_block(t: Tables) -> DataFrame:
    """Each subject's newest facts, every object once, within a budget of tokens."""
    order = [F.desc("valid_from"), F.desc("triple_id")]
    once = fusion.first_wins(t.triples, ["subject", "object"], order).withColumn("tokens", F.ceil((F.length("object") + 10) / 4))
    return fusion.within_budget(once, "subject", order, "tokens", 6).select("subject", "object")


@query("session_containment", "recall", "WITH s AS (SELECT session_id, doc_id, min(surfaced_at) AS started, max(surfaced_at) AS ended FROM recall GROUP BY ALL) SELECT r.id, min(s.session_id) AS session_id FROM recall r JOIN s ON s.doc_id = r.doc_id AND r.surfaced_at BETWEEN s.started AND s.ended GROUP BY r.id")
def session_containment(t: Tables) -> DataFrame:
    """The session whose time holds an event; of several the first by name."""
    e = t.recall_events.withColumn("day", F.to_date("surfaced_at"))  # a session lies within a day
    s = e.groupBy("session_id", "doc_id", "day").agg(F.min("surfaced_at").alias("started"), F.max("surfaced_at").alias("ended")).withColumnRenamed("session_id", "s")
    return e.join(s, ["doc_id", "day"]).where("surfaced_at between started and ended").groupBy("id").agg(F.min("s").alias("session_id"))


@query("look_back", "", "WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), w AS (SELECT *, lag(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS a, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM u) SELECT conv_id, turn, sha256(text || CASE WHEN a IS NOT NULL AND a <> text AND length(text) + length(a) <= 2000 THEN chr(10) || a || CASE WHEN b IS NOT NULL AND b <> text AND b <> a AND length(text) + length(a) + length(b) <= 2000 THEN chr(10) || b ELSE '' END ELSE '' END) AS prompt FROM w")
def look_back(t: Tables) -> DataFrame:
    """A prompt with up to two different ones before it, whole and 2000 characters in all."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = t.conversations.where("role = 'user'").withColumn("a", F.lag("text", 1).over(w)).withColumn("b", F.lag("text", 2).over(w))
    n = F.length("text") + F.length("a")
    second = F.when(F.col("b").isNotNull() & (F.col("b") != F.col("text")) & (F.col("b") != F.col("a")) & (n + F.length("b") <= 2000), F.concat(F.lit("\n"), "b")).otherwise("")
    first = F.when(F.col("a").isNotNull() & (F.col("a") != F.col("text")) & (n <= 2000), F.concat(F.lit("\n"), "a", second)).otherwise("")
    return u.select("conv_id", "turn", F.sha2(F.concat("text", first), 256).alias("prompt"))


@query("nudge_counter", "", "SELECT conv_id, turn, turn - coalesce(max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS since FROM conversations")
def nudge_counter(t: Tables) -> DataFrame:
    """Turns since the last of a kind."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", (F.col("turn") - F.coalesce(F.max(F.when(F.col("role") == "system", F.col("turn"))).over(w), F.lit(-1))).alias("since"))


@query("causal_chain", "recall", f"WITH RECURSIVE {searching._EDGES_SQL}, c AS (SELECT source_id, target_id FROM edges WHERE relation_type = 'causal'), chain(doc_id, depth) AS (SELECT max(source_id), 0 FROM c UNION SELECT target_id, depth + 1 FROM chain JOIN c ON source_id = doc_id WHERE depth < 3) SELECT doc_id, min(depth) AS depth FROM chain GROUP BY doc_id")
def causal_chain(t: Tables) -> DataFrame:
    """What follows from a document along causal edges, at its least depth."""
    c = searching.edges(t).where("relation_type = 'causal'")
    seen = c.agg(F.max("source_id").alias("doc_id")).withColumn("depth", F.lit(0))
    level = seen
    for d in range(1, 4):
        level = level.join(c, F.col("doc_id") == F.col("source_id")).select(F.col("target_id").alias("doc_id")).distinct().join(seen.select("doc_id"), "doc_id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen


@query("relation_snippets", "recall", f"WITH {searching._EDGES_SQL}, s AS (SELECT DISTINCT doc_id FROM recall WHERE was_referenced) SELECT source_id, target_id, relation_type, weight FROM edges WHERE source_id IN (SELECT doc_id FROM s) AND target_id IN (SELECT doc_id FROM s) ORDER BY weight DESC, source_id, target_id, relation_type LIMIT 10")
def relation_snippets(t: Tables) -> DataFrame:
    """The ten strongest edges inside a set of documents."""
    s = t.recall_events.where("was_referenced").select("doc_id").distinct()
    e = searching.edges(t).join(s.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi").join(s.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi")
    return e.orderBy(F.desc("weight"), "source_id", "target_id", "relation_type").limit(10).select("source_id", "target_id", "relation_type", "weight")


@query("meta_path_fusion", "recall")
def meta_path_fusion(t: Tables) -> DataFrame:
    """Forward push along two paths of edge types; each document with its better score, top 30."""
    anchors = t.recall_events.groupBy("doc_id").agg((F.count("*") / 1000).alias("score"))
    e = searching.edges(t)
    both = graph.forward_push(anchors, e, ["causal", "semantic"]).unionByName(graph.forward_push(anchors, e, ["semantic", "temporal"]))
    return both.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(30).withColumn("score", r6(F.col("score")))


@query("traversal_merge", "docs", f"WITH {searching.SEARCH_SQL}, o AS (SELECT query_id, doc_id, hit / n_terms AS s FROM found), n AS (SELECT query_id, doc_id, s / max(s) OVER (PARTITION BY query_id) AS n FROM o) SELECT coalesce(a.query_id, n.query_id) AS query_id, coalesce(a.doc_id, n.doc_id) AS doc_id, round(CASE WHEN a.doc_id IS NULL THEN 0.8 * n WHEN n IS NULL THEN a.score ELSE greatest(a.score, 1.1 * n) END, 6) AS score FROM surface a FULL JOIN n ON n.query_id = a.query_id AND n.doc_id = a.doc_id")
def traversal_merge(t: Tables) -> DataFrame:
    """Results of a traversal, relative to their best, put into a list: raised where they are in
    it already, at 0.8 where they are new."""
    o = searching.overlapping(t).withColumn("s", F.col("hit") / F.col("n_terms"))
    best = few(o.groupBy("query_id").agg(F.max("s").alias("best")))
    n = o.join(best, "query_id").withColumn("n", F.col("s") / F.col("best"))
    return n.select("query_id", "doc_id", r6(F.when(F.col("score").isNull(), 0.8 * F.col("n")).otherwise(F.greatest("score", 1.1 * F.col("n")))).alias("score"))


@query("co_activation_boost", "docs baskets", f"WITH {textual.SCORED_SQL}, r AS (SELECT id, collection, sure, row_number() OVER (PARTITION BY collection ORDER BY modified_at DESC, id) AS r, count(*) OVER (PARTITION BY collection) AS n FROM sure WHERE active), h AS (SELECT * FROM r WHERE r <= greatest(1, floor(n / 4))), p AS (SELECT a.item AS a, b.item AS b, count(*) AS c FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item <> b.item GROUP BY ALL), m AS (SELECT x.id, max(c) AS c FROM r x JOIN p ON p.b = x.id JOIN h ON h.id = p.a AND h.collection = x.collection WHERE x.r > greatest(1, floor(x.n / 4)) GROUP BY x.id) SELECT r.id, round(sure * (1 + least(coalesce(m.c, 0) / 10, 0.15)), 6) AS score FROM r LEFT JOIN m ON m.id = r.id")
def co_activation_boost(t: Tables) -> DataFrame:
    """Of each list the first quarter, in its order, raises what was used together with it."""
    w = Window.partitionBy("collection")
    d = textual.scored(t).where("active").select("id", "collection", "sure", F.row_number().over(w.orderBy(F.desc("modified_at"), "id")).alias("r"), F.count("*").over(w).alias("n"))
    d = d.withColumn("hot", F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    p = graph.pair_counts(t.baskets)
    sides = p.select("a", "b", "n").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).withColumnRenamed("n", "c")
    hot = d.where("hot").select(F.col("id").alias("a"), F.col("collection").alias("hc"))
    m = d.where("not hot").select("id", "collection").join(sides, F.col("id") == F.col("b")).join(hot, "a").where("hc = collection").groupBy("id").agg(F.max("c").alias("c"))
    return d.join(m, "id", "left").select("id", r6(F.col("sure") * (1 + F.least(F.coalesce("c", F.lit(0)) / 10, F.lit(0.15)))).alias("score"))


@query("topic_boost", "docs", f"WITH {textual.SCORED_SQL}, m AS (SELECT id, sure, contains(lower(body), 'the') AS hit, max(contains(lower(body), 'the')::INT) OVER (PARTITION BY collection) AS any_ FROM sure WHERE active) SELECT id, round(CASE WHEN any_ = 0 THEN sure WHEN hit THEN sure * 1.4 ELSE greatest(sure * 0.5, sure * 0.75) END, 6) AS score FROM m")
def topic_boost(t: Tables) -> DataFrame:
    """What fits a session's topic is raised, what doesn't lowered; nothing if nothing fits."""
    hit = F.contains(F.lower("body"), F.lit("the"))
    d = textual.scored(t).where("active").select("id", "sure", hit.alias("hit"), F.max(hit.cast("int")).over(Window.partitionBy("collection")).alias("any"))
    return d.select("id", r6(F.when(F.col("any") == 0, F.col("sure")).when(F.col("hit"), F.col("sure") * 1.4).otherwise(F.col("sure") * 0.75)).alias("score"))


@query("consolidation_merge", "mentions", "SELECT entity, count(DISTINCT doc_id) AS proofs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM mentions GROUP BY entity")
def consolidation_merge(t: Tables) -> DataFrame:
    """Observations of one kind as one, with the number of their sources."""
    return t.mentions.groupBy("entity").agg(F.countDistinct("doc_id").alias("proofs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("entity_edges", "mentions", """WITH m AS (SELECT doc_id, entity FROM mentions UNION ALL SELECT DISTINCT l_orderkey, 'part:' || l_partkey FROM lineitem), i AS (SELECT entity, ln(((SELECT count(DISTINCT doc_id) FROM m) + 1) / (count(*) + 1)) AS idf FROM m GROUP BY entity),
r AS (SELECT doc_id, entity, idf FROM m JOIN i USING (entity) WHERE idf >= 3), s AS (SELECT a.doc_id AS a, b.doc_id AS b, max(a.idf) AS idf FROM r a JOIN r b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY ALL), o AS (SELECT doc_id, list(entity) AS own FROM m GROUP BY doc_id),
c AS (SELECT a, b, idf, len(list_intersect(x.own, y.own)) AS shared FROM s JOIN o x ON x.doc_id = a JOIN o y ON y.doc_id = b) SELECT a, b, shared, round(least(1.0, 0.3 + 0.12 * idf + least(0.15, 0.05 * (shared - 1))), 6) AS weight FROM c""")
def entity_edges(t: Tables) -> DataFrame:
    """Orders that share a rare part, brand or type; common ones count too."""
    from ..operators import entity

    # An order's lines come together once, with what names their parts; from there on nothing moves until entities are counted.
    part = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type")).alias("named"))
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey").join(part, "l_partkey", "left").repartition("doc_id")
    names = F.concat(F.array(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))), F.coalesce("named", F.array().cast("array<string>")))
    return entity.entity_edges(lines.select("doc_id", F.explode(names).alias("entity")).distinct()).withColumn("weight", r6(F.col("weight")))


@query("query_rate_gate", "recall", "SELECT id, count(*) OVER (PARTITION BY doc_id ORDER BY epoch(surfaced_at) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM recall")
def query_rate_gate(t: Tables) -> DataFrame:
    """How many lookups the last ten minutes saw, by which heavy work is held back."""
    w = Window.partitionBy("doc_id").orderBy("s").rangeBetween(-600, 0)
    return t.recall_events.withColumn("s", F.unix_micros(F.col("surfaced_at").cast("timestamp")) / 1e6).select("id", F.count("*").over(w).alias("recent"))


@query("review_due", "docs", f"SELECT collection, id, days FROM (SELECT collection, id, floor((epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400)::BIGINT AS days, row_number() OVER (PARTITION BY collection ORDER BY modified_at, id) AS r FROM docs WHERE active AND (epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400 >= 30) WHERE r <= 5")
def review_due(t: Tables) -> DataFrame:
    """The five documents of each collection that have gone longest without a change."""
    d = t.documents.where("active").where(Time.age_days(F.col("modified_at"), NOW) >= 30)
    w = Window.partitionBy("collection").orderBy("modified_at", "id")
    return d.withColumn("r", F.row_number().over(w)).where("r <= 5").select("collection", "id", Time.whole_days(F.col("modified_at"), NOW).alias("days"))


@query("proximity_order")
def proximity_order(t: Tables) -> DataFrame:
    """The thirty best of each query, those first in which its words stand together."""
    bodies = t.documents.select(F.col("id").alias("doc_id"), "body")
    terms = searching.questions(t).select("query_id", T.query_terms(F.col("query")).alias("terms"))
    top = bodies.join(few(searching.any_ranked(t).select("query_id", "doc_id", "rank").join(terms, "query_id")), "doc_id")
    return proximity.rerank(top.withColumn("words", T.tokens(F.col("body"))))


@query("revision_patch", "docs", "SELECT content_type, count(*) AS n, sum(revision_count)::BIGINT AS revisions FROM (SELECT content_type, revision_count + CASE WHEN invalidated THEN 1 ELSE 0 END AS revision_count FROM docs) GROUP BY 1")
def revision_patch(t: Tables) -> DataFrame:
    changes = t.documents.where("invalidated").select("id", (F.col("revision_count") + 1).alias("revision_count"))
    d = lifecycle.patch(t.documents.select("id", "content_type", "revision_count"), changes, "id")
    return d.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("revision_count").alias("revisions"))
