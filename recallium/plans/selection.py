"""Queries that select and describe documents, collections, names and relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..sources.tables import Tables, sql
from . import search

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    """Register a function of the model's tables under a name, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


@query("recency_intents", "", f"SELECT conv_id, turn, coalesce(regexp_matches(text, '{intent.any_of(intent.RECENT)}'), false) AS recent FROM conversations")
def recency_intents(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", intent.wants_recent(F.col("text")).alias("recent"))


_ASKED = "what does the owner prefer: profile and preferences"


@query(
    "canonical_multipliers", "docs",
    f"WITH q AS (SELECT * FROM (VALUES (1, '{_ASKED}'), (2, 'the latest of {_ASKED}'), (3, 'rivers')) AS v(query_id, q)) SELECT query_id, id, (CASE WHEN NOT regexp_matches(q, '{intent.any_of(intent.STABLE)}') OR regexp_matches(q, '{intent.any_of(intent.RECENT)}') THEN 1.0 WHEN regexp_matches(path, '{intent.any_of(intent.PROFILE_PATHS)}') THEN 1.14 WHEN content_type = 'preference' THEN 1.08 ELSE 1.0 END)::DOUBLE AS multiplier FROM q, docs",
)
def canonical_multipliers(t: Tables) -> DataFrame:
    """For three fixed queries, how much more each document counts."""
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("query_id"), F.lit(q).alias("q")) for k, q in enumerate((_ASKED, f"the latest of {_ASKED}", "rivers"), 1))))
    d = t.documents.select("id", "path", "content_type", asked.alias("a"))
    return d.select("a.query_id", "id", intent.canonical_multiplier(F.col("path"), F.col("content_type"), F.col("a.q")).alias("multiplier"))


@query("embed_formats", "docs", "SELECT id, md5('title: ' || coalesce(nullif(title, ''), 'none') || ' | text: ' || body) AS document, 'task: search result | query: ' || title AS query FROM docs")
def embed_formats(t: Tables) -> DataFrame:
    return t.documents.select("id", F.md5(intent.document_for_embedding(F.col("body"), F.col("title"))).alias("document"), intent.query_for_embedding(F.col("title")).alias("query"))


@query("junk_expansions", "", f"SELECT conv_id, turn, coalesce(trim(text) = '' OR regexp_matches(text, '{intent.any_of(intent.JUNK)}'), true) AS junk FROM conversations")
def junk_expansions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", intent.junk(F.col("text")).alias("junk"))


@query("title_keys", "docs", r"SELECT id, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS title_key FROM docs")
def title_keys(t: Tables) -> DataFrame:
    return t.documents.select("id", intent.title_key(F.col("title")).alias("title_key"))


@query(
    "document_references", "docs",
    r"""WITH m AS (SELECT *, regexp_replace(split_part(path, '/', -1), '(?i)\.(md|txt)$', '') AS name FROM docs)
SELECT id, turn, coalesce(contains(text, path) OR (length(name) > 3 AND contains(lower(text), lower(name))) OR (length(title) >= 5 AND contains(lower(text), lower(title))), false) AS referenced FROM m JOIN conversations ON conv_id = id""",
)
def document_references(t: Tables) -> DataFrame:
    """Whether the turns of the conversation that goes with a document name it."""
    d = t.documents.join(t.conversations.select(F.col("conv_id").alias("id"), "turn", "text"), "id")
    return d.select("id", "turn", F.coalesce(intent.mentions_document(F.col("text"), F.col("path"), F.col("title")), F.lit(False)).alias("referenced"))


@query("days_in_months", "", "SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(last_day(o_orderdate))::INT AS days FROM orders")
def days_in_months(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.raw("orders").select(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(F.last_day(d)).alias("days")).distinct()


def stale_batch(docs: DataFrame, recalled: DataFrame, kinds: list[str], limit: int) -> DataFrame:
    """The documents of some types that were recalled, read or changed longest ago."""
    last = recalled.groupBy(F.col("doc_id").alias("id")).agg(F.max("surfaced_at").alias("last_recalled_at"))
    d = docs.where(F.col("active") & F.col("content_type").isin(kinds)).join(last, "id", "left")
    d = d.select("id", "content_type", F.coalesce("last_recalled_at", "last_accessed_at", "modified_at").alias("seen"), "modified_at")
    return d.orderBy("seen", "modified_at", "id").limit(limit).select("id", "content_type")


_STALE = """WITH l AS (SELECT doc_id, max(surfaced_at) AS last_recalled_at FROM recall GROUP BY doc_id) SELECT id, content_type FROM docs LEFT JOIN l ON l.doc_id = docs.id WHERE active AND content_type IN ({kinds})
ORDER BY coalesce(last_recalled_at, last_accessed_at, modified_at), modified_at, id LIMIT {n}"""
#: Types of documents from which conclusions are drawn.
DEDUCTIVE = ["decision", "preference", "milestone", "problem"]


@query("stale_deductive_batch", "docs recall", _STALE.format(kinds=", ".join(f"'{k}'" for k in DEDUCTIVE), n=50))
def stale_deductive_batch(t: Tables) -> DataFrame:
    return stale_batch(t.documents, t.recall_events, DEDUCTIVE, 50)


@query("stale_observation_batch", "docs recall", _STALE.format(kinds="'note'", n=30))
def stale_observation_batch(t: Tables) -> DataFrame:
    return stale_batch(t.documents, t.recall_events, ["note"], 30)


@query("exact_types", "", "SELECT lower(p_brand) AS name, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS kind FROM part GROUP BY 1 UNION ALL SELECT lower(p_name), CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END FROM part GROUP BY 1")
def exact_types(t: Tables) -> DataFrame:
    """The type of a name if all its rows have one and the same, else null."""
    p = t.raw("part").select(F.explode(F.array("p_brand", "p_name")).alias("name"), "p_size")
    one = p.groupBy(F.lower("name").alias("name")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    return one.select("name", F.when(F.col("low") == F.col("high"), F.col("low")).alias("kind"))


@query("entity_input_hashes", "docs", "SELECT id, sha256(title || chr(0) || body) AS input_hash FROM docs")
def entity_input_hashes(t: Tables) -> DataFrame:
    return t.documents.select("id", F.sha2(F.concat("title", F.lit("\0"), "body"), 256).alias("input_hash"))


@query("valid_locations", "", r"WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'vm  ' || s_suppkey WHEN 1 THEN 'host 10.0.0.' || s_suppkey || ' b' ELSE s_name END AS name FROM supplier) SELECT s_suppkey, name, regexp_matches(name, '(?i)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|^VM\s+\d+') AS valid FROM n")
def valid_locations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("vm  "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("host 10.0.0."), k.cast("string"), F.lit(" b"))).otherwise(F.col("s_name"))
    return t.raw("supplier").select("s_suppkey", name.alias("name")).withColumn("valid", intent.valid_location(F.col("name")))


def archived_search(docs: DataFrame, asked: str, limit: int) -> DataFrame:
    """Archived documents that hold a text in title, path, collection or body, the newest first."""
    low = F.lit(asked.lower())
    hit = F.contains(F.lower("title"), low) | F.contains(F.lower("path"), low) | F.contains(F.lower("collection"), low) | F.contains(F.lower("body"), low)
    return docs.where("not active or invalidated").where(hit).orderBy(F.desc("modified_at"), "id").limit(limit).select("id", "path", F.lit(1.0).alias("score"))


@query("archived_search", "docs", "SELECT id, path, 1.0::DOUBLE AS score FROM docs WHERE (NOT active OR invalidated) AND (contains(lower(title), 'th') OR contains(lower(path), 'th') OR contains(lower(collection), 'th') OR contains(lower(body), 'th')) ORDER BY modified_at DESC, id LIMIT 20")
def archived(t: Tables) -> DataFrame:
    return archived_search(t.documents, "TH", 20)


def multi_get(docs: DataFrame, patterns: list[str], max_bytes: int) -> DataFrame:
    """Documents whose path is listed or fits a glob; those too large come with the reason and no body."""
    import fnmatch

    hit = F.lit(False)
    for p in patterns:
        hit = hit | (F.col("path").rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$") if set(p) & set("*?[") else F.col("path") == p)
    size = F.octet_length("body")
    return docs.where("active").where(hit).select("id", "path", size.cast("long").alias("bytes"), F.when(size > max_bytes, F.concat(F.lit("larger than "), F.lit(max_bytes).cast("string"), F.lit(" bytes"))).alias("skipped"), F.when(size <= max_bytes, F.md5("body")).alias("body_md5"))


@query("multi_get", "docs", r"SELECT id, path, octet_length(encode(body)) AS bytes, CASE WHEN octet_length(encode(body)) > 2000 THEN 'larger than 2000 bytes' END AS skipped, CASE WHEN octet_length(encode(body)) <= 2000 THEN md5(body) END AS body_md5 FROM docs WHERE active AND (path = 'en/doc-3.md' OR regexp_matches(path, '^fr/.*\.md$'))")
def multi_get_query(t: Tables) -> DataFrame:
    return multi_get(t.documents, ["en/doc-3.md", "fr/*.md"], 2000)


@query("orphaned_prefixes", "docs", "SELECT DISTINCT collection, split_part(path, '/', 1) AS prefix FROM docs WHERE active AND path LIKE '%/%' AND split_part(path, '/', 1) NOT IN ('en', 'de')")
def orphaned_prefixes(t: Tables) -> DataFrame:
    """First parts of paths that no context covers; contexts stand at en and de."""
    covered = t.spark.createDataFrame([("en",), ("de",)], "prefix string")
    seen = t.documents.where("active and path like '%/%'").select("collection", F.split_part("path", F.lit("/"), F.lit(1)).alias("prefix")).distinct()
    return seen.join(F.broadcast(covered), "prefix", "left_anti").select("collection", "prefix")


@query("uncovered_collections", "docs", "SELECT collection AS name, count(*) FILTER (active) AS doc_count FROM docs WHERE collection NOT IN (SELECT collection FROM docs WHERE pinned AND content_type = 'hub') GROUP BY collection")
def uncovered_collections(t: Tables) -> DataFrame:
    """Collections without a context of their own (a pinned hub), with the number of their documents."""
    has = t.documents.where("pinned and content_type = 'hub'").select("collection").distinct()
    return t.documents.join(has, "collection", "left_anti").groupBy(F.col("collection").alias("name")).agg(F.count_if("active").alias("doc_count"))


@query("relation_counts", "docs recall", f"WITH {search._EDGES_SQL} SELECT relation_type, count(*) AS n FROM edges JOIN docs a ON a.id = source_id AND a.active JOIN docs b ON b.id = target_id AND b.active GROUP BY relation_type")
def relation_counts(t: Tables) -> DataFrame:
    """Edges by type whose both ends are active."""
    live = t.documents.where("active").select("id")
    e = search.edges(t)
    e = e.join(live.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(live.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.groupBy("relation_type").agg(F.count("*").alias("n"))


@query("deactivation_reasons", "docs", "SELECT CASE WHEN NOT active THEN 'empty' WHEN invalidated THEN 'invalidated' END AS reason, count(*) AS n FROM docs GROUP BY 1")
def deactivation_reasons(t: Tables) -> DataFrame:
    """Documents by reason; those without one are a group."""
    return t.documents.groupBy(F.when(~F.col("active"), "empty").when(F.col("invalidated"), "invalidated").alias("reason")).agg(F.count("*").alias("n"))


@query("mixed_models", "docs vectors", "SELECT collection, count(DISTINCT label) AS models, count(DISTINCT label) > 1 AS mixed FROM docs JOIN vectors ON doc_id = id WHERE active GROUP BY collection")
def mixed_models(t: Tables) -> DataFrame:
    """How many kinds of vectors the active documents of a collection have."""
    both = t.documents.where("active").select("id", "collection").join(t.vectors.select(F.col("doc_id").alias("id"), "label"), "id")
    return both.groupBy("collection").agg(F.countDistinct("label").alias("models")).withColumn("mixed", F.col("models") > 1)


@query("active_paths", "docs", "SELECT collection, path FROM docs WHERE active AND collection = (SELECT min(collection) FROM docs)")
def active_paths(t: Tables) -> DataFrame:
    first = t.documents.agg(F.min("collection").alias("collection"))
    return t.documents.where("active").join(F.broadcast(first), "collection").select("collection", "path")  # first is one row


@query("recalled_documents", "docs recall", "SELECT doc_id, count(*) AS recalls FROM recall JOIN docs ON docs.id = doc_id AND active GROUP BY doc_id HAVING count(*) >= 3")
def recalled_documents(t: Tables) -> DataFrame:
    """Active documents that came up at least three times."""
    n = t.recall_events.groupBy("doc_id").agg(F.count("*").alias("recalls")).where("recalls >= 3")
    return n.join(t.documents.where("active").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


@query("vault_union", "docs", "SELECT 'own' AS vault, id, title FROM docs WHERE active UNION ALL SELECT 'shared', item_id, substring(split_part(coalesce(text, ''), chr(10), 1), 1, 60) FROM benchmark")
def vault_union(t: Tables) -> DataFrame:
    """Documents of two vaults, each with its vault's name."""
    shared = t.raw("benchmark").select(F.lit("shared").alias("vault"), F.col("item_id").alias("id"), F.substring(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), 1, 60).alias("title"))
    return t.documents.where("active").select(F.lit("own").alias("vault"), "id", "title").unionByName(shared)


@query(
    "explained_tops", "docs",
    f"WITH {search.SEARCH_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS by_score, row_number() OVER (PARTITION BY query_id ORDER BY round(search, 9) DESC, doc_id) AS by_search FROM surface) SELECT query_id, doc_id, by_score <= 10 AS in_composite, by_search <= 10 AS in_raw FROM r WHERE by_score <= 10 OR by_search <= 10",
)
def explained_tops(t: Tables) -> DataFrame:
    """The ten best documents of each query by composite score and the ten by search alone, as one list."""
    rank = {c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 9)), "doc_id")) for c in ("score", "search")}
    r = search.searched(t).select("query_id", "doc_id", (rank["score"] <= 10).alias("in_composite"), (rank["search"] <= 10).alias("in_raw"))
    return r.where("in_composite or in_raw")
