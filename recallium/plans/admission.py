"""Queries of model answers, sessions, named things and path rules, each with its SQL.

The tables hold no answers of models, so answers are put together from lines of orders by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import admission, chunk
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


#: An entry of an answer, said in a way that both engines evaluate alike.
_ENTRY = """concat('{"relation": "', element_at(array('same', 'update', 'contradiction', 'same|update'), CAST(l_partkey % 4 + 1 AS INT)),
 '", "reasoning": ', element_at(array('"..."', '123', '"it says so"', '"{{why}}"', '"both name it"'), CAST(l_suppkey % 5 + 1 AS INT)),
 ', "confidence": ', element_at(array('0.7', '0.9', '"0.9"', '1.5', '0.4'), CAST(l_linenumber % 5 + 1 AS INT)),
 ', "old_idx": ', CAST(l_linenumber % 3 AS STRING), ', "new_idx": ', element_at(array('0', '1', '1.5', '7'), CAST(l_partkey % 8 / 2 + 1 AS INT)), '}')"""
_ENTRY_SQL = _ENTRY.replace("element_at(array(", "list_extract([").replace("'), CAST", "'], CAST").replace("STRING", "VARCHAR").replace("CAST(l_partkey % 8 / 2 + 1 AS INT)", "CAST(l_partkey % 8 // 2 + 1 AS INT)")
ANSWERS_SQL = f"""answers AS (SELECT k, CASE k % 7 WHEN 0 THEN 'no answer' WHEN 1 THEN '{{"result": [' || b || ']}}' WHEN 2 THEN '{{"other": [' || b || ']}}' ELSE '[' || b || ']' END AS raw
  FROM (SELECT l_orderkey AS k, string_agg(e, ', ' ORDER BY l_linenumber, e) AS b FROM (SELECT *, {_ENTRY_SQL} AS e FROM lineitem) GROUP BY l_orderkey)),
lists AS (SELECT k, CASE WHEN json_valid(raw) THEN CASE json_type(raw::JSON) WHEN 'ARRAY' THEN raw::JSON WHEN 'OBJECT' THEN json_extract(raw::JSON, '$.result') END END AS l FROM answers),
e AS (SELECT k, i AS position, json_extract(l, i) AS e FROM (SELECT k, l, unnest(range(json_array_length(l)::BIGINT)) AS i FROM lists WHERE l IS NOT NULL)),
f AS (SELECT k, position, json_extract_string(e, '$.relation') AS relation, json_extract_string(e, '$.reasoning') AS reasoning, json_type(e, '$.reasoning') AS told, json_type(e, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS counted, try_cast(json_extract_string(e, '$.confidence') AS DOUBLE) AS confidence, try_cast(json_extract_string(e, '$.old_idx') AS DOUBLE) AS old_idx, try_cast(json_extract_string(e, '$.new_idx') AS DOUBLE) AS new_idx FROM e),
judged AS (SELECT *, CASE WHEN relation NOT IN ('same', 'update', 'contradiction') THEN 'invalid-relation' WHEN told <> 'VARCHAR' THEN 'invalid-reasoning' WHEN reasoning = '...' OR reasoning LIKE '{{{{%}}}}' THEN 'placeholder-reasoning' WHEN NOT counted OR confidence NOT BETWEEN 0 AND 1 THEN 'invalid-confidence'
  WHEN NOT (old_idx BETWEEN 0 AND 1 AND new_idx BETWEEN 0 AND 2 AND new_idx = floor(new_idx)) THEN 'index-out-of-range' ELSE 'ok' END AS verdict FROM f)"""


def answers(t: Tables) -> DataFrame:
    """(k, raw): an answer for each order, with an entry for each of its lines."""
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.expr(_ENTRY.replace("l_partkey % 8 / 2 + 1", "l_partkey % 8 DIV 2 + 1")).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "e"))), lambda s: s.e), ", ")
    b, form = F.col("b"), F.col("k") % 7
    raw = F.when(form == 0, "no answer").when(form == 1, F.concat(F.lit('{"result": ['), b, F.lit("]}"))).when(form == 2, F.concat(F.lit('{"other": ['), b, F.lit("]}"))).otherwise(F.concat(F.lit("["), b, F.lit("]")))
    return lines.groupBy("k").agg(body.alias("b")).select("k", raw.alias("raw"))


def judged(t: Tables) -> DataFrame:
    return admission.entries(answers(t), "k", "raw", 2, 3)


@query("contradiction_verdicts", "", f"WITH {ANSWERS_SQL} SELECT k, position::INT AS position, verdict, coalesce(verdict = 'ok' AND relation = 'contradiction' AND confidence >= 0.5, false) AS actionable FROM judged")
def contradiction_verdicts(t: Tables) -> DataFrame:
    """What each entry of an answer is refused for, and whether it states a contradiction to act on."""
    j = judged(t)
    return j.select("k", "position", "verdict", F.coalesce((F.col("verdict") == "ok") & admission.actionable(F.col("relation"), F.col("confidence")), F.lit(False)).alias("actionable"))


_PAIRS_SQL = "pairs AS (SELECT k, old_idx, new_idx, count(*) AS entries, count(DISTINCT (relation, confidence, reasoning)) AS answers FROM judged WHERE verdict = 'ok' GROUP BY ALL)"


@query(
    "contradiction_batches", "",
    f"WITH {ANSWERS_SQL}, {_PAIRS_SQL}, p AS (SELECT k, count(*) FILTER (answers = 1) AS accepted, sum(CASE WHEN answers = 1 THEN entries - 1 ELSE 0 END)::BIGINT AS duplicates, count(*) FILTER (answers > 1) AS inconsistent FROM pairs GROUP BY k), r AS (SELECT k, count(*) FILTER (verdict <> 'ok') AS rejected FROM judged GROUP BY k) SELECT k, rejected, coalesce(accepted, 0) AS accepted, coalesce(duplicates, 0) AS duplicates, coalesce(inconsistent, 0) AS inconsistent FROM r LEFT JOIN p USING (k)",
)
def contradiction_batches(t: Tables) -> DataFrame:
    return admission.batches(judged(t), "k")


_META = """CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"origin": "import"}' WHEN 2 THEN '[1]' WHEN 3 THEN '{"reasoning": " ", "source_fact": "a", "target_fact": "b"}'
 WHEN 4 THEN concat('{"reasoning": "for order ', CAST(o_orderkey AS {text}), '", "source_fact": "', repeat(o_orderpriority, 60), '", "target_fact": "', o_orderstatus, '"}') ELSE '{"reasoning": "cut' END"""
_WEIGHT = "CAST(o_custkey % 13 AS DOUBLE) / 10"


@query(
    "legacy_witnesses", "",
    f"WITH m AS (SELECT o_orderkey, {_META.replace('{text}', 'VARCHAR')} AS meta, {_WEIGHT} AS weight FROM orders) SELECT o_orderkey, meta->>'reasoning' AS reasoning, substring(meta->>'source_fact', 1, 300) AS source_fact, substring(meta->>'target_fact', 1, 300) AS target_fact, weight AS confidence FROM m WHERE o_orderkey % 6 = 4 AND weight <= 1",
)
def legacy_witnesses(t: Tables) -> DataFrame:
    """Edges whose metadata state what they rest on."""
    e = t.raw("orders").select("o_orderkey", admission.legacy_witness(F.expr(_META.replace("{text}", "STRING")), F.expr(_WEIGHT)).alias("w"))
    return e.where("w is not null").select("o_orderkey", "w.*")


@query(
    "unresolved_edges", "docs recall",
    f"WITH {search._EDGES_SQL}, lane AS (SELECT id FROM docs WHERE active AND path LIKE 'en/%'), w AS (SELECT source_id, target_id FROM edges WHERE relation_type = 'semantic') SELECT source_id, target_id, weight FROM edges e WHERE relation_type = 'causal' AND source_id IN (SELECT id FROM lane) AND target_id IN (SELECT id FROM lane) AND NOT EXISTS (SELECT 1 FROM w WHERE w.source_id = e.source_id AND w.target_id = e.target_id)",
)
def unresolved_edges(t: Tables) -> DataFrame:
    """Causal edges between English documents that no edge of likeness supports."""
    e = search.edges(t)
    lane = t.documents.where("active and path like 'en/%'")
    return admission.census(e, lane, e.where("relation_type = 'semantic'").select("source_id", "target_id")).select("source_id", "target_id", "weight")


_FACTS = """CASE conv_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '["one", 2]' WHEN 3 THEN concat('["', role, '", "turn ', CAST(turn AS {text}), '"]') ELSE '["one", "  "]' END"""


@query("stored_facts", "", f"SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 THEN 2 END::INT AS n_facts, CASE WHEN conv_id % 5 = 3 THEN role || '|turn ' || turn END AS facts FROM (SELECT conv_id, turn, role, {_FACTS.replace('{text}', 'VARCHAR')} AS raw FROM conversations)")
def stored_facts(t: Tables) -> DataFrame:
    """Lists of facts; those that hold anything but texts count as none."""
    found = t.conversations.select("conv_id", "turn", admission.facts(F.expr(_FACTS.replace("{text}", "STRING"))).alias("f"))
    return found.select("conv_id", "turn", F.when(F.col("f").isNotNull(), F.size("f")).alias("n_facts"), F.array_join("f", "|").alias("facts"))


_LINKS = """concat('[{"target_idx": ', CAST(turn AS {text}), ', "link_type": "', CASE conv_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'supporting' ELSE 'friends' END, '", "confidence": 0.', CAST(turn % 10 AS {text}), ', "reasoning": "said"}]')"""


@query("link_answers", "", "SELECT conv_id, turn, turn::BIGINT AS target_idx, CASE conv_id % 3 WHEN 0 THEN 'semantic' ELSE 'supporting' END AS link_type, turn % 10 / 10 AS confidence FROM conversations WHERE conv_id % 3 < 2 AND turn > 0")
def link_answers(t: Tables) -> DataFrame:
    """Links of answers in which every link is valid."""
    found = t.conversations.select("conv_id", "turn", F.explode(admission.links(F.expr(_LINKS.replace("{text}", "STRING")))).alias("l"))
    return found.select("conv_id", "turn", "l.target_idx", "l.link_type", "l.confidence")


@query(
    "observation_fragments", "docs",
    "WITH o AS (SELECT id, title, body, [substring(body, 1, 60), substring(body, 61, 20), substring(body, 81, 50)] AS facts FROM docs), p AS (SELECT id, 'full' AS kind, 0 AS seq, body AS content FROM o UNION ALL SELECT id, 'fact', i, f FROM (SELECT id, unnest(list_filter(facts, lambda f: length(f) >= 50)) AS f, generate_subscripts(list_filter(facts, lambda f: length(f) >= 50), 1) - 1 AS i FROM o) UNION ALL SELECT id, 'narrative', 0, title FROM o WHERE length(title) >= 50) SELECT id, kind, seq::INT AS seq, md5(content) AS content FROM p",
)
def observation_fragments(t: Tables) -> DataFrame:
    told = F.to_json(F.array(*(F.substring("body", a, n) for a, n in ((1, 60), (61, 20), (81, 50)))))
    o = t.documents.select("id", "title", "body", told.alias("facts"))
    return admission.observation_fragments(o, "id", "body", "facts", "title").select("id", "kind", "seq", F.md5("content").alias("content"))


#: How many entities a document of a type may state; others 10.
ENTITY_CAPS = {"research": 15, "hub": 12, "conversation": 12, "decision": 8, "deductive": 8, "note": 8, "handoff": 8, "progress": 8, "project": 10}


def entity_cap(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ENTITY_CAPS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.trim(kind))), F.lit(10))


@query("entity_caps", "docs", "SELECT id, CASE WHEN content_type = 'research' THEN 15 WHEN content_type IN ('hub', 'conversation') THEN 12 WHEN content_type IN ('decision', 'deductive', 'note', 'handoff', 'progress') THEN 8 ELSE 10 END AS cap FROM docs")
def entity_caps(t: Tables) -> DataFrame:
    return t.documents.select("id", entity_cap(F.col("content_type")).alias("cap"))


def entity_search(entities: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Entities (entity, name, mention_count) with one of some words in their name, those most mentioned
    first; if that gives too few, then those with a word that begins so."""
    own = T.tokens(F.col("name"))
    asked = F.array(*map(F.lit, words))
    begins = F.exists(own, lambda w: F.exists(asked, lambda a: F.startswith(w, a)))
    tier = F.when(F.arrays_overlap(own, asked), 0).when(begins, 1)
    return entities.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("mention_count"), "entity").limit(limit)


_ASKED_SQL = "list_has_any(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['red', 'wid'])"


@query(
    "entity_search", "",
    f"WITH l AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1), e AS (SELECT p_name AS name, count(*) AS mention_count, sum(n - 1)::BIGINT AS cooccurrence_count FROM l JOIN n USING (l_orderkey) GROUP BY 1), t AS (SELECT *, CASE WHEN {_ASKED_SQL} THEN 0 WHEN regexp_matches(lower(name), '(^|[^a-z0-9])(red|wid)') THEN 1 END AS tier FROM e) SELECT name, tier, mention_count, cooccurrence_count FROM t WHERE tier IS NOT NULL ORDER BY tier, mention_count DESC, name LIMIT 12",
)
def entity_search_query(t: Tables) -> DataFrame:
    """Names of parts as entities; what an entity occurs with is counted by its documents' sizes, without pairs."""
    named = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    met = t.raw("lineitem").select("l_orderkey", "l_partkey").join(named, "l_partkey").select("l_orderkey", "name").distinct()
    sizes = met.groupBy("l_orderkey").agg((F.count("*") - 1).alias("others"))
    e = met.join(sizes, "l_orderkey").groupBy("name").agg(F.count("*").alias("mention_count"), F.sum("others").alias("cooccurrence_count"))
    return entity_search(e.withColumn("entity", F.col("name")), ["red", "wid"], 12).select("name", "tier", "mention_count", "cooccurrence_count")


#: Words that say nothing of an intent.
INTENT_STOPWORDS = "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can about how what when where which who whom why this that these those it its not no so if then than".split()
_INTENT_STOP_SQL = ", ".join(f"'{w}'" for w in INTENT_STOPWORDS)


def intent_terms(text: Column) -> Column:
    """The words of an intent, stripped to letters of a to z, digits and hyphens."""
    words = F.filter(F.split(F.lower(text), rf"{T.SPACE}+"), lambda w: (F.length(w) > 1) & ~w.isin(INTENT_STOPWORDS))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9-]", "")), lambda w: F.length(w) > 1)


@query("intent_terms", "", rf"SELECT item_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '[\t-\r ]+'), lambda w: length(w) > 1 AND w NOT IN ({_INTENT_STOP_SQL})), lambda w: regexp_replace(w, '[^a-z0-9-]', '', 'g')), lambda w: length(w) > 1), ' ') AS terms FROM benchmark")
def intent_terms_query(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.array_join(intent_terms(F.col("text")), " ").alias("terms"))


def best_chunk(text: Column, query_words: list[str], intent_words: list[str], size: int = 4000, overlap: int = 200) -> Column:
    """(score, start, piece) of the window that holds most of a query's words, each 1, and of its intent's,
    each a half; the first such."""
    windows = chunk.windows(text, size, overlap)

    def scored(w: Column) -> Column:
        low, score = F.lower(w.piece), F.lit(0.0)
        for words, weight in ((query_words, 1.0), (intent_words, 0.5)):
            for word in words:
                score = score + F.when(F.contains(low, F.lit(word)), weight).otherwise(0.0)
        return F.struct(score.alias("score"), (-w.start).alias("back"), w.piece.alias("piece"))

    best = F.array_max(F.transform(windows, scored))
    return F.struct(best.score.alias("score"), (-best.back).alias("start"), best.piece.alias("piece"))


_QUERY_WORDS, _INTENT_WORDS, _SIZE, _OVERLAP = ["an", "ore", "tu"], ["be", "si"], 400, 20
_CHUNK_SCORE_SQL = " + ".join(f"CASE WHEN contains(lower(piece), '{w}') THEN {x} ELSE 0 END" for ws, x in ((_QUERY_WORDS, 1.0), (_INTENT_WORDS, 0.5)) for w in ws)


@query(
    "rerank_chunks", "docs",
    f"WITH s AS (SELECT id, body, unnest(range(0, greatest(length(body) - {_OVERLAP + 1}, 0) + 1, {_SIZE - _OVERLAP})) AS start FROM docs), p AS (SELECT id, start, substring(body, start + 1, {_SIZE}) AS piece FROM s), c AS (SELECT *, ({_CHUNK_SCORE_SQL})::DOUBLE AS score FROM p) SELECT id, score, start::INT AS start, md5(piece) AS piece FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start) AS r FROM c) WHERE r = 1",
)
def rerank_chunks(t: Tables) -> DataFrame:
    """The part of each document that a reranker should read for a fixed query and intent."""
    d = t.documents.select("id", best_chunk(F.col("body"), _QUERY_WORDS, _INTENT_WORDS, _SIZE, _OVERLAP).alias("c"))
    return d.select("id", "c.score", "c.start", F.md5("c.piece").alias("piece"))


def supplemented(found: DataFrame, more: DataFrame) -> DataFrame:
    """Results (query_id, doc_id, rank) and, after them, those of a second list that they lack."""
    unseen = more.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return found.select("query_id", "doc_id", F.lit(0).alias("leg"), "rank").unionByName(unseen.select("query_id", "doc_id", F.lit(1).alias("leg"), "rank"))


@query(
    "supplemented_results", "docs",
    f"WITH {search.LISTS_SQL}, a AS (SELECT query_id, doc_id, rank FROM lists WHERE list = 'overlap' AND rank < 10), b AS (SELECT query_id, doc_id, rank FROM lists WHERE list = 'bm25' AND rank < 5) SELECT query_id, doc_id, 0 AS leg, rank FROM a UNION ALL SELECT query_id, doc_id, 1, rank FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id)",
)
def supplemented_results(t: Tables) -> DataFrame:
    """Ten results of each query by overlap, and of the five best by keyword those not among them."""
    both = search.lists(t)
    return supplemented(both.where("list = 'overlap' and rank < 10"), both.where("list = 'bm25' and rank < 5"))


@query("allowed_paths", "docs", "SELECT id, NOT (contains(path, 'fr/') OR contains(path, 'doc-1')) AS allowed FROM docs")
def allowed_paths(t: Tables) -> DataFrame:
    """Paths without any of some substrings."""
    hit = F.lit(False)
    for part in ("fr/", "doc-1"):
        hit = hit | F.contains("path", F.lit(part))
    return t.documents.select("id", (~hit).alias("allowed"))


_SESSIONS_SQL = "s AS (SELECT session_id, min(surfaced_at) AS started FROM recall GROUP BY 1 ORDER BY started DESC, session_id LIMIT 10)"


def newest_sessions(t: Tables, n: int) -> DataFrame:
    return t.recall_events.groupBy("session_id").agg(F.min("surfaced_at").alias("started")).orderBy(F.desc("started"), "session_id").limit(n)


@query("directory_sessions", "docs recall", f"WITH {_SESSIONS_SQL} SELECT session_id FROM s WHERE session_id IN (SELECT r.session_id FROM recall r JOIN docs ON docs.id = r.doc_id WHERE starts_with(path, 'en/')) ORDER BY started DESC, session_id LIMIT 3")
def directory_sessions(t: Tables) -> DataFrame:
    """Of the ten newest sessions, the three newest that touched documents under a folder."""
    under = t.documents.where(F.startswith("path", F.lit("en/"))).select(F.col("id").alias("doc_id"))
    s = F.broadcast(newest_sessions(t, 10))  # ten rows
    touched = t.recall_events.join(s, "session_id").select("session_id", "started", "doc_id").join(under, "doc_id", "left_semi")
    return touched.select("session_id", "started").distinct().orderBy(F.desc("started"), "session_id").limit(3).select("session_id")


@query("profile_staleness", "docs recall", "WITH s AS (SELECT session_id, min(surfaced_at) AS started FROM recall GROUP BY 1), h AS (SELECT id, modified_at FROM docs WHERE content_type = 'hub' AND active), n AS (SELECT h.id, count(*) FILTER (started > modified_at) AS since FROM h, (SELECT * FROM s ORDER BY started DESC, session_id LIMIT 6) GROUP BY h.id) SELECT id, since >= 5 AS stale FROM n")
def profile_staleness(t: Tables) -> DataFrame:
    """Whether at least five of the six newest sessions began after a profile's last change."""
    newest = newest_sessions(t, 6).agg(F.collect_list("started").alias("started"))
    hubs = t.documents.where("active and content_type = 'hub'").select("id", "modified_at").join(F.broadcast(newest))  # one row
    return hubs.select("id", (F.size(F.filter("started", lambda s: s > F.col("modified_at"))) >= 5).alias("stale"))


@query("session_usage", "recall", "WITH l AS (SELECT session_id FROM recall GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1) SELECT id, doc_id, row_number() OVER (PARTITION BY session_id ORDER BY surfaced_at, id) AS turn FROM recall WHERE session_id = (SELECT session_id FROM l)")
def session_usage(t: Tables) -> DataFrame:
    """What the busiest session used, in order; a session is one user's day."""
    busiest = t.recall_events.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").limit(1).select("session_id")
    used = t.recall_events.join(F.broadcast(busiest), "session_id")  # one row
    return used.select("id", "doc_id", F.row_number().over(Window.partitionBy("session_id").orderBy("surfaced_at", "id")).alias("turn"))


@query("audit_counts", "recall", "SELECT count(DISTINCT session_id) AS runs, count(*) AS events, min(surfaced_at) AS oldest FROM recall")
def audit_counts(t: Tables) -> DataFrame:
    return t.recall_events.agg(F.countDistinct("session_id").alias("runs"), F.count("*").alias("events"), F.min("surfaced_at").alias("oldest"))
