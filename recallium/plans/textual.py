"""Queries of scalar functions on text, time and scores over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import time as Time
from ..functions import unicode
from ..operators import entity
from ..sources.tables import NOW, Tables, sql

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


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOK = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_AGE = f"((epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400)"
_AGE_ACCESS = f"((epoch(TIMESTAMP '{NOW}') - epoch(last_accessed_at)) / 86400)"


@query("hashes", "docs", r"SELECT id, substring(hash, 1, 6) AS docid, sha256(trim(regexp_replace(lower(body), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS normalized, substring(sha1(trim(lower(title))), 1, 12) AS query_hash, substring(sha256(collection || '/' || path), 1, 16) AS canonical FROM docs")
def hashes(t: Tables) -> DataFrame:
    return t.documents.select("id", T.docid(F.col("hash")).alias("docid"), T.normalized_hash(F.col("body")).alias("normalized"), T.query_hash(F.col("title")).alias("query_hash"), T.canonical_id(F.col("collection"), F.col("path")).alias("canonical"))


@query("slugs", "docs", "SELECT id, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug, 'memory://' || collection || '/' || path AS uri, ceil(length(body) / 4)::BIGINT AS tokens FROM docs")
def slugs(t: Tables) -> DataFrame:
    return t.documents.select("id", T.slug(F.col("title")).alias("slug"), T.virtual_path(F.col("collection"), F.col("path")).alias("uri"), T.token_estimate(F.col("body")).alias("tokens"))


@query("query_terms", "", f"WITH q AS (SELECT item_id, list_distinct({TOK.format(x='text')}) AS w FROM benchmark) SELECT item_id, array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({_STOP}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({_STOP})) ELSE w END), ' ') AS terms FROM q")
def query_terms(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query("escapes", "", """SELECT page_id, CASE WHEN regexp_matches(html, '[,"\n]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END AS csv, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def escapes(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.csv_escape(F.col("html")).alias("csv"), T.xml_escape(F.col("html")).alias("xml"))


@query("line_slices", "docs", "WITH l AS (SELECT id, string_split(body, chr(10)) AS l FROM docs) SELECT id, array_to_string(list_slice(l, 2, 4), chr(10)) AS slice, array_to_string(list_transform(list_zip(range(1, len(l) + 1), l), lambda z: z[1]::VARCHAR || ': ' || z[2]), chr(10)) AS numbered FROM l")
def line_slices(t: Tables) -> DataFrame:
    return t.documents.select("id", T.lines(F.col("body"), 2, 3).alias("slice"), T.numbered_lines(F.col("body")).alias("numbered"))


@query("excluded_paths", "", "SELECT page_id, len(list_filter(string_split(url, '/'), lambda p: p IN ('node_modules', 'dist', 'build', '.git', '__pycache__') OR (starts_with(p, '.') AND p <> '.') OR starts_with(p, '_'))) > 0 AS excluded FROM pages")
def excluded_paths(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.excluded_path(F.col("url")).alias("excluded"))


@query("negations", "docs", r"SELECT id, regexp_matches(lower(body), '(^|[^a-z])(not|no|never|none|cannot|without|nicht|kein|pas|jamais|nunca)([^a-z]|$)') AS negated, len(regexp_extract_all(body, '[0-9][0-9,]*(?:[.][0-9]+)?')) AS n_numbers FROM docs")
def negations(t: Tables) -> DataFrame:
    return t.documents.select("id", T.negated(F.col("body")).alias("negated"), F.size(T.numbers(F.col("body"))).cast("long").alias("n_numbers"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SIGNS = " + ".join(f"CASE WHEN regexp_matches(body, {_quoted(p)}) THEN {s} ELSE 0 END" for p, s in T.QUALITY_SIGNS)


@query("quality_scores", "docs", f"SELECT id, round(least(1.0, greatest(0.0, 0.3 + CASE WHEN length(body) > 200 THEN 0.1 ELSE 0 END + CASE WHEN length(body) > 500 THEN 0.1 ELSE 0 END + {_SIGNS} + CASE WHEN length(source) > 0 THEN 0.05 ELSE 0 END - CASE WHEN length(body) < 50 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS quality FROM (SELECT *, collection AS source FROM docs)")
def quality_scores(t: Tables) -> DataFrame:
    """Documents' worth; the collection stands for their domain."""
    return t.documents.select("id", r6(T.quality_score(F.col("body"), domain=F.col("collection"))).alias("quality"))


@query("content_types", "", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{k}'" for k, p in T.PATH_TYPES) + " ELSE 'note' END AS content_type FROM pages")
def content_types(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.content_type(F.col("url")).alias("content_type"))


_LAYERS = [(n, s, f"regexp_matches(substring(text, 1, {T.INJECTION_HEAD}), {_quoted(p)})") for n, s, p in T.INJECTIONS]


@query("injection_patterns", "transcripts", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {hit} THEN '{n}'" for n, _, hit in _LAYERS) + " END AS name, CASE " + " ".join(f"WHEN {hit} THEN {s}::DOUBLE" for _, s, hit in _LAYERS) + " ELSE 0::DOUBLE END AS score FROM transcripts")
def injection_patterns(t: Tables) -> DataFrame:
    return t.transcripts.select("conv_id", "turn", T.injection(F.col("text")).alias("i")).select("conv_id", "turn", "i.name", "i.score")


@query("injections")
def injections(t: Tables) -> DataFrame:
    """All layers; no SQL, as DuckDB has no compatibility decomposition."""
    return t.documents.select("id", unicode.injection(F.col("body")).alias("i")).select("id", "i.name", "i.score")


@query("sanitized_snippets")
def sanitized_snippets(t: Tables) -> DataFrame:
    return t.transcripts.select("conv_id", "turn", unicode.sanitized(T.truncated(F.col("text"))).alias("snippet"))


_RSTRIP = r"regexp_replace({x}, '[\t-\r ]+\z', '')"
_KEPT = {k: f"regexp_extract(substring(body, 1, 300), '{p}', 1)" for k, p in T.BREAKS.items()}


@query("truncated_bodies", "docs", "SELECT id, md5(CASE WHEN length(body) <= 300 THEN body " + " ".join(f"WHEN length({x}) > 150 THEN " + (x if k == "sentence" else _RSTRIP.format(x=x) + (" || '...'" if k == "word" else "")) for k, x in _KEPT.items()) + f" ELSE {_RSTRIP.format(x='substring(body, 1, 300)')} || '...' END) AS head FROM docs")
def truncated_bodies(t: Tables) -> DataFrame:
    return t.documents.select("id", F.md5(T.truncated(F.col("body"))).alias("head"))


@query("routes", "transcripts", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {_quoted(p)}) THEN '{n}'" for n, p in T.ROUTES) + f" END AS route, trim(lower(text)) = '' OR starts_with(trim(lower(text)), '/') OR regexp_matches(lower(text), '{'|'.join(T.HEARTBEATS)}') AS heartbeat FROM transcripts")
def routes(t: Tables) -> DataFrame:
    return t.transcripts.select("conv_id", "turn", T.route(F.col("text")).alias("route"), T.heartbeat(F.col("text")).alias("heartbeat"))


@query("pruned_outputs", "transcripts", f"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '{T.TOOL_OUTPUT}', '', 'g'), '{T.FILE_DUMP}', '[file content pruned]' || chr(10), 'g')) AS text FROM transcripts")
def pruned_outputs(t: Tables) -> DataFrame:
    return t.transcripts.select("conv_id", "turn", F.md5(T.pruned(F.col("text"))).alias("text"))


_POINTS = {k: f"(CASE WHEN regexp_matches(text, '{p}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '{lead}') THEN 2 ELSE 0 END)" for k, (p, lead) in T.INTENTS.items()}


@query("intents", "", f"WITH p AS (SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in _POINTS.items())} FROM conversations), m AS (SELECT *, greatest(WHY, \"WHEN\", ENTITY) AS top FROM p) SELECT conv_id, turn, CASE WHEN top = 0 THEN 'WHAT' WHEN WHY = top THEN 'WHY' WHEN \"WHEN\" = top THEN 'WHEN' ELSE 'ENTITY' END AS intent, round(CASE WHEN top > 0 THEN least(0.95, 0.6 + 0.1 * top) ELSE 0.6 END, 6)::DOUBLE AS confidence FROM m".replace(" AS WHEN", ' AS "WHEN"'))
def intents(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.intent", r6(F.col("i.confidence")).alias("confidence"))


@query("retrieval_modes", "", "SELECT conv_id, turn, CASE " + " ".join("WHEN regexp_matches(text, '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in T.MODES) + " ELSE 'hybrid' END AS mode FROM conversations")
def retrieval_modes(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.retrieval_mode(F.col("text")).alias("mode"))


@query("name_similarity", "", "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(last)) / greatest(length(p_name), length(last)), 6)::DOUBLE AS ratio FROM (SELECT *, lag(p_name) OVER (PARTITION BY p_brand, p_type ORDER BY p_name, p_partkey) AS last FROM part) WHERE last IS NOT NULL")
def name_similarity(t: Tables) -> DataFrame:
    """How like each name is to the one before it in its group's order."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_name", "p_partkey")
    p = t.raw("part").withColumn("last", F.lag("p_name").over(w)).where("last is not null")
    return p.select("p_partkey", r6(T.similarity_ratio(F.lower("p_name"), F.lower("last"))).alias("ratio"))


@query(
    "entity_resolution", "",
    "WITH n AS (SELECT DISTINCT c_name AS name, 'org' AS block FROM customer), k AS (SELECT DISTINCT s_name AS entity, 'org' AS block FROM supplier), nw AS (SELECT DISTINCT name, block, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM n), kw AS (SELECT DISTINCT entity, block, unnest(string_split_regex(lower(entity), '[^a-z0-9]+')) AS word FROM k), p AS (SELECT DISTINCT name, block, entity FROM nw JOIN kw USING (block, word) WHERE word <> ''), m AS (SELECT *, 1 - levenshtein(lower(name), lower(entity)) / greatest(length(name), length(entity)) AS ratio FROM p) SELECT name, block, entity, round(ratio, 6)::DOUBLE AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY name, block ORDER BY ratio DESC, entity) AS r FROM m WHERE ratio >= 0.5) WHERE r = 1",
)
def entity_resolution(t: Tables) -> DataFrame:
    names = t.raw("customer").select(F.col("c_name").alias("name"), entity.bucket(F.lit("organization")).alias("block")).distinct()
    known = t.raw("supplier").select(F.col("s_name").alias("name"), entity.bucket(F.lit("team")).alias("block")).distinct()
    return entity.resolve(names, known, 0.5).withColumn("ratio", r6(F.col("ratio")))


@query("entity_ids", "", "SELECT p_partkey, 'default:brand:' || substring(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS entity_id FROM part")
def entity_ids(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", entity.entity_id("default", F.lit("brand"), F.col("p_brand")).alias("entity_id"))


@query(
    "text_jaccard", "docs",
    f"WITH w AS (SELECT conv_id, turn, list_distinct({TOK.format(x='text')}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6)::DOUBLE AS jaccard FROM p",
)
def text_jaccard(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", T.word_set(F.col("text")).alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", r6(T.jaccard(F.col("w"), F.col("y"))).alias("jaccard"))


@query("day_ranges", "transcripts", """SELECT conv_id, turn, m, CASE m WHEN 'today' THEN DATE '2025-01-01' WHEN 'yesterday' THEN DATE '2024-12-31' END AS d FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\btoday\\b') THEN 'today' WHEN regexp_matches(text, '(?i)\\byesterday\\b') THEN 'yesterday' END AS m FROM transcripts) WHERE m IS NOT NULL""".replace("\\\\", "\\"))
def day_ranges(t: Tables) -> DataFrame:
    m = F.when(F.col("text").rlike(T.ascii_words(r"(?i)\btoday\b")), "today").when(F.col("text").rlike(T.ascii_words(r"(?i)\byesterday\b")), "yesterday")
    span = Time.phrase_range(m, F.lit("2025-01-01").cast("date"))
    return t.transcripts.select("conv_id", "turn", m.alias("m"), span["first"].alias("d")).where("m is not null")


@query("week_starts", "", "SELECT o_orderkey, strftime(o_orderdate::DATE - dayofweek(o_orderdate::DATE)::INT, '%Y-%m-%d') AS week FROM orders")
def week_starts(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.date_format(Time.week_start(F.to_date("o_orderdate")), "yyyy-MM-dd").alias("week"))


@query("quiet_hours", "", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS quiet, floor((epoch(TIMESTAMP '2025-01-01') - epoch(ts)) / 86400)::BIGINT AS days FROM events")
def quiet_hours(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", Time.in_quiet_hours(F.hour("ts"), 22, 6).alias("quiet"), Time.whole_days(F.col("ts"), NOW).alias("days"))


@query("json_values", "", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events")
def json_values(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"), "value")


_HL = "CASE WHEN content_type IN ('preference', 'deductive', 'hub', 'antipattern') THEN NULL " + " ".join(f"WHEN content_type = '{k}' THEN {v}" for k, v in S.HALF_LIVES.items()) + f" ELSE {S.UNKNOWN_HALF_LIFE} END"
_BASE = "CASE " + " ".join(f"WHEN content_type = '{k}' THEN {v}" for k, v in S.BASELINES.items()) + " ELSE 0.5 END"
SCORED_SQL = f"""aged AS (SELECT *, {_AGE} AS d, {_AGE_ACCESS} AS da, {_HL} AS hl0, {_BASE} AS base FROM docs),
lives AS (SELECT *, least(hl0 * (1 + 0.3 * ln(1 + access_count * greatest(0, 1 - da / 90))), hl0 * 3) AS hl FROM aged),
scored AS (SELECT *, CASE WHEN hl IS NULL OR d <= 0 THEN 1.0 ELSE pow(0.5, d / hl) END AS recency FROM lives),
sure0 AS (SELECT *, least(1.0, base * recency * least(1.5, 1 + 0.1 * log2(1 + access_count)) * CASE WHEN content_type IN ('decision', 'deductive', 'preference', 'hub', 'research', 'antipattern') THEN 1 ELSE greatest(0.5, pow(0.95, da / 7)) END) AS computed FROM scored),
sure AS (SELECT *, CASE WHEN confidence = 0.5 THEN computed ELSE least(1.0, computed * (confidence / 0.5) * 0.5 + computed * 0.5) END AS sure FROM sure0)"""


def scored(t: Tables) -> DataFrame:
    """Documents with recency, confidence and the factors of the composite."""
    d = t.documents.withColumn("d", Time.age_days(F.col("modified_at"), NOW)).withColumn("da", Time.age_days(F.col("last_accessed_at"), NOW))
    d = d.withColumn("hl", S.effective_half_life(F.col("content_type"), F.col("access_count"), F.col("da")))
    d = d.withColumn("recency", S.recency(F.col("d"), F.col("hl")))
    computed = S.confidence(F.col("content_type"), F.col("d"), F.col("hl"), F.col("access_count"), F.col("da"))
    return d.withColumn("sure", S.stored_blend(F.col("confidence"), computed))


@query("scores", "docs", f"WITH {SCORED_SQL} SELECT id, round(recency, 6) AS recency, round(sure, 6) AS confidence, CASE WHEN sure > 0.8 THEN 'HOT' WHEN sure > 0.6 THEN 'WARM' ELSE 'COLD' END AS tier, CASE WHEN content_type IN ('handoff', 'conversation', 'progress') THEN 'episodic' WHEN content_type = 'antipattern' THEN 'procedural' ELSE 'semantic' END AS memory_type FROM sure")
def scores(t: Tables) -> DataFrame:
    return scored(t).select("id", r6(F.col("recency")).alias("recency"), r6(F.col("sure")).alias("confidence"), S.tier(F.col("sure")).alias("tier"), S.memory_type(F.col("content_type")).alias("memory_type"))


COMPOSITE_SQL = """CASE WHEN pinned THEN least(1.0, s + 0.3) ELSE s END"""
FACTORS_SQL = "(0.7 + 0.6 * quality_score) * greatest(0.3, 1 / (1 + 0.5 * log2(greatest(length(body) / 500, 1.0)))) * (1 + least(0.1, 0.03 * ln(1 + 2 * (revision_count - 1) + (duplicate_count - 1))))"


def factors():
    return S.quality_factor(F.col("quality_score")) * S.length_factor(F.length("body")) * S.frequency_factor(F.col("revision_count"), F.col("duplicate_count"))


@query("composite_scores", "docs", f"WITH {SCORED_SQL}, c AS (SELECT *, (0.5 * 0.5 + recency * 0.25 + sure * 0.25) * {FACTORS_SQL} AS s FROM sure) SELECT id, round({COMPOSITE_SQL}, 6) AS score FROM c WHERE active AND NOT invalidated")
def composite_scores(t: Tables) -> DataFrame:
    s = S.composite(F.lit(0.5), F.col("recency"), F.col("sure")) * factors()
    return scored(t).where("active and not invalidated").select("id", r6(S.pinned(s, F.col("pinned"))).alias("score"))


@query("stale_sections", "docs", f"WITH {SCORED_SQL} SELECT id, round(CASE WHEN pinned THEN 1000 ELSE 0 END + greatest(0, 100 - 5 * d) + 2 * access_count, 6)::DOUBLE AS focus FROM sure WHERE active ORDER BY focus DESC, id LIMIT 25")
def stale_sections(t: Tables) -> DataFrame:
    focus = F.when(F.col("pinned"), 1000).otherwise(0) + F.greatest(F.lit(0.0), 100 - 5 * F.col("d")) + 2 * F.col("access_count")
    return scored(t).where("active").select("id", r6(focus).alias("focus")).orderBy(F.desc("focus"), "id").limit(25)
