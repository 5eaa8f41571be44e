"""Queries of explanation, promotion, profiles, packing and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import entity, extract, fusion
from ..sources.tables import NOW, Tables, sql
from . import extraction, textual
from . import search as searching

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


@query("explain_breakdown", "docs", f"WITH {textual.SCORED_SQL} SELECT id, round(d, 6) AS days, round(hl, 6) AS half_life, round(recency, 6) AS recency, round(base, 6)::DOUBLE AS baseline, round(sure, 6) AS confidence, round(0.7 + 0.6 * quality_score, 6) AS quality, round(greatest(0.3, 1 / (1 + 0.5 * log2(greatest(length(body) / 500, 1.0)))), 6) AS length, round(1 + least(0.1, 0.03 * ln(1 + 2 * (revision_count - 1) + (duplicate_count - 1))), 6) AS frequency, pinned FROM sure")
def explain_breakdown(t: Tables) -> DataFrame:
    """All factors of a document's composite score."""
    c = F.col
    return textual.scored(t).select(
        "id", r6(c("d")).alias("days"), r6(c("hl")).alias("half_life"), r6(c("recency")).alias("recency"), r6(S._lookup(c("content_type"), S.BASELINES, 0.5)).alias("baseline"), r6(c("sure")).alias("confidence"),
        r6(S.quality_factor(c("quality_score"))).alias("quality"), r6(S.length_factor(F.length("body"))).alias("length"), r6(S.frequency_factor(c("revision_count"), c("duplicate_count"))).alias("frequency"), "pinned",
    )


@query("position_blend", "docs", f"WITH {searching.LISTS_SQL}, rr AS (SELECT query_id, doc_id, hit / n_terms AS rerank FROM found), r AS (SELECT f.query_id, f.doc_id, rrf / max(rrf) OVER (PARTITION BY f.query_id) AS n, coalesce(rerank, 0) AS rerank, row_number() OVER (PARTITION BY f.query_id ORDER BY round(rrf, 9) DESC, f.doc_id) - 1 AS rank FROM fused f LEFT JOIN rr ON rr.query_id = f.query_id AND rr.doc_id = f.doc_id) SELECT query_id, doc_id, round(CASE WHEN rank < 3 THEN 0.75 * n + 0.25 * rerank WHEN rank < 10 THEN 0.6 * n + 0.4 * rerank ELSE 0.4 * n + 0.6 * rerank END, 6) AS score FROM r")
def position_blend(t: Tables) -> DataFrame:
    """Fused and reranked scores, the fused one counting more in the first places."""
    fused, again = searching.fused(t)
    d = fusion.ranked(fused.withColumn("key", F.round("rrf", 9)), "key").withColumn("n", F.col("rrf") / F.max("rrf").over(Window.partitionBy("query_id"))).join(again, ["query_id", "doc_id"], "left")
    return d.select("query_id", "doc_id", r6(fusion.position_blend(F.col("rank"), F.col("n"), F.coalesce("rerank", F.lit(0.0)))).alias("score"))


@query("procedural_promotion", "docs", """WITH r AS (SELECT collection, id, content_type, row_number() OVER (PARTITION BY collection ORDER BY modified_at DESC, id) - 1 AS r FROM docs WHERE active),
p AS (SELECT collection, min(r) AS p FROM r WHERE content_type = 'antipattern' GROUP BY 1) SELECT r.collection, id, CASE WHEN p <= 3 OR p IS NULL THEN r WHEN r = p THEN 3 WHEN r >= 3 AND r < p THEN r + 1 ELSE r END AS rank FROM r LEFT JOIN p ON p.collection = r.collection""")
def procedural_promotion(t: Tables) -> DataFrame:
    """The first procedural memory of a list comes fourth if it came later."""
    w = Window.partitionBy("collection")
    d = t.documents.where("active").withColumn("r", F.row_number().over(w.orderBy(F.desc("modified_at"), "id")) - 1)
    d = d.withColumn("p", F.min(F.when(F.col("content_type") == "antipattern", F.col("r"))).over(w))
    rank = F.when(F.col("p").isNull() | (F.col("p") <= 3), F.col("r")).when(F.col("r") == F.col("p"), 3).when((F.col("r") >= 3) & (F.col("r") < F.col("p")), F.col("r") + 1).otherwise(F.col("r"))
    return d.select("collection", "id", rank.alias("rank"))


@query("titles", "docs", r"SELECT id, CASE WHEN regexp_matches(body, '(^|\n)#{1,2} +[^\n]') THEN trim(regexp_extract(body, '(?:^|\n)#{1,2} +([^\n]+)', 1)) ELSE title END AS title FROM docs")
def titles(t: Tables) -> DataFrame:
    """The first heading, else the first line."""
    heading = F.regexp_extract("body", r"(?:^|\n)#{1,2} +([^\n]+)", 1)
    return t.documents.select("id", F.when(heading != "", F.trim(heading)).otherwise(F.col("title")).alias("title"))


@query("transcript_pack", "", "WITH p AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN role = 'user' AND turn = fu THEN 0 WHEN role = 'assistant' AND turn = la THEN 1 WHEN role = 'system' THEN 4 ELSE 3 END AS priority FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS fu, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS la FROM conversations)), s AS (SELECT *, sum(n) OVER w AS total, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY priority, turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, priority FROM s WHERE r = 1 OR total <= 1500")
def transcript_pack(t: Tables) -> DataFrame:
    """What of a transcript fits a budget of characters, by the turns' priority."""
    w = Window.partitionBy("conv_id")
    first, last = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)
    p = F.when((F.col("role") == "user") & (F.col("turn") == first), 0).when((F.col("role") == "assistant") & (F.col("turn") == last), 1).when(F.col("role") == "system", 4).otherwise(3)
    d = t.conversations.select("conv_id", "turn", F.length("text").alias("n"), p.alias("priority"))
    return fusion.within_budget(d, "conv_id", ["priority", "turn"], "n", 1500).select("conv_id", "turn", "priority")


@query("evidence_sentences", "docs", f"WITH {searching.QUESTIONS_SQL}, long AS (SELECT query_id, unnest(list_filter(terms, lambda w: length(w) > 3)) AS term FROM qt), z AS (SELECT id AS doc_id, {extraction._sentences('body')} AS s FROM docs), e AS (SELECT doc_id, unnest(range(len(s))) AS place, trim(unnest(s)) AS sentence FROM z), w AS (SELECT DISTINCT doc_id, place, unnest({textual.TOK.format(x='sentence')}) AS term FROM e) SELECT query_id, doc_id, place, count(*) AS shared FROM w JOIN long USING (term) GROUP BY ALL HAVING count(*) >= 2")
def evidence_sentences(t: Tables) -> DataFrame:
    """Sentences that share two long words or more with a question."""
    long = searching.questions(t).select("query_id", F.explode(F.filter(T.query_terms(F.col("query")), lambda w: F.length(w) > 3)).alias("term"))
    e = t.documents.select(F.col("id").alias("doc_id"), F.posexplode(extract.sentences(F.col("body"))).alias("place", "sentence"))
    w = e.select("doc_id", "place", F.explode(T.word_set(F.col("sentence"))).alias("term"))
    return w.join(long, "term").groupBy("query_id", "doc_id", "place").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("mixed_scripts", "docs", r"SELECT id, len(list_filter(regexp_extract_all(body, '[\p{L}]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\p{Cyrillic}\p{Greek}]'))) > 0 AS mixed, regexp_matches(trim(lower(body)), '^(todo|tbd|n/a|none|placeholder|\.*)$') AS placeholder FROM docs")
def mixed_scripts(t: Tables) -> DataFrame:
    """Words that mix Latin with look-alike scripts, and bodies that are placeholders."""
    words = F.regexp_extract_all("body", F.lit(r"[\p{L}]+"), F.lit(0))
    mixed = F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))) > 0
    return t.documents.select("id", mixed.alias("mixed"), F.trim(F.lower("body")).rlike(r"^(todo|tbd|n/a|none|placeholder|\.*)$").alias("placeholder"))


@query("metrics_by_tag", "docs", f"WITH {searching._METRICS_SQL}, tags AS (SELECT DISTINCT g.query_id, d.lang AS tag FROM gold g JOIN docs d ON d.id = g.doc_id) SELECT tag, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM m JOIN tags USING (query_id) GROUP BY tag")
def metrics_by_tag(t: Tables) -> DataFrame:
    tags = searching.gold(t).join(t.documents.select(F.col("id").alias("doc_id"), F.col("lang").alias("tag")), "doc_id").select("query_id", "tag").distinct()
    return searching.measured(t).join(tags, "query_id").groupBy("tag").agg(F.count("*").alias("n"), r6(F.avg("recall")).alias("recall"), r6(F.avg("mrr")).alias("mrr"))


@query("retired_edges", "recall", f"WITH {searching._EDGES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation_type) AS r FROM edges) SELECT source_id, target_id, relation_type, r > 10 AS retired, sha256(source_id || '|' || target_id || '|' || relation_type) AS fingerprint FROM w")
def retired_edges(t: Tables) -> DataFrame:
    """Edges beyond each source's ten strongest go to an archive, told by their fingerprint."""
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "relation_type")
    mark = F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), F.col("target_id").cast("string"), "relation_type"), 256)
    return searching.edges(t).select("source_id", "target_id", "relation_type", (F.row_number().over(w) > 10).alias("retired"), mark.alias("fingerprint"))


@query("edge_union", "recall", f"WITH {searching._EDGES_SQL} SELECT source_id AS node, target_id AS other, relation_type FROM edges UNION SELECT target_id, source_id, relation_type FROM edges WHERE relation_type IN ('semantic', 'entity')")
def edge_union(t: Tables) -> DataFrame:
    """Outbound edges, and inbound ones of symmetric types."""
    e = searching.edges(t)
    back = e.where(F.col("relation_type").isin("semantic", "entity")).select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "relation_type")
    return e.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "relation_type").unionByName(back).distinct()


@query("cache_keys", "recall", """SELECT id, sha256('http://model/rank' || '{"query":"' || query_hash || '","doc":' || doc_id || '}') AS cache_key FROM recall""")
def cache_keys(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.col("query_hash").alias("query"), F.col("doc_id").alias("doc")))
    return t.recall_events.select("id", F.sha2(F.concat(F.lit("http://model/rank"), body), 256).alias("cache_key"))


@query("temporal_leg", "docs", f"SELECT id, round(1 - least(1.0, abs(epoch(modified_at) - epoch(TIMESTAMP '2024-08-15')) / (30 * 86400)), 6) AS score FROM docs WHERE active AND NOT invalidated AND modified_at BETWEEN TIMESTAMP '2024-08-01' AND TIMESTAMP '2024-08-31' ORDER BY modified_at DESC, id LIMIT 30")
def temporal_leg(t: Tables) -> DataFrame:
    """Documents of a time range, newest first, scored by how near its middle they lie."""
    middle = F.unix_timestamp(F.lit("2024-08-15 00:00:00"))
    d = t.documents.where("active and not invalidated").where(F.col("modified_at").between(F.to_timestamp(F.lit("2024-08-01")), F.to_timestamp(F.lit("2024-08-31"))))
    return d.orderBy(F.desc("modified_at"), "id").limit(30).select("id", r6(1 - F.least(F.lit(1.0), F.abs(F.unix_timestamp("modified_at") - middle) / (30 * 86400))).alias("score"))


@query("entity_names", "", "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN false ELSE 1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)) <= 0.85 AND length(p_name) <= 60 AND NOT suffix(p_name, ':') END AS good FROM part")
def entity_names(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", entity.good_name(F.col("p_name"), F.col("p_type")).alias("good"))


@query("prompt_entities", "", f"WITH w AS (SELECT conv_id, turn, {textual.TOK.format(x='text')} AS w FROM conversations), g AS (SELECT DISTINCT conv_id, turn, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT conv_id, turn, w, unnest([1, 2, 3]) AS n FROM w), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)), names AS (SELECT DISTINCT lower(c_mktsegment) AS gram FROM customer UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT 'the') SELECT conv_id, turn, gram FROM g JOIN names USING (gram)")
def prompt_entities(t: Tables) -> DataFrame:
    """Known names among a turn's runs of one to three words, found by a join."""
    w = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))

    def grams(n: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", F.slice("w", i, n)))
        return w.where(F.size("w") >= n).select("conv_id", "turn", F.explode(each).alias("gram"))

    found = grams(1).unionByName(grams(2)).unionByName(grams(3)).distinct()
    names = t.raw("customer").select(F.lower("c_mktsegment").alias("gram")).unionByName(t.raw("nation").select(F.lower("n_name").alias("gram"))).unionByName(t.spark.range(1).select(F.lit("the").alias("gram"))).distinct()
    return found.join(names, "gram").select("conv_id", "turn", "gram")


@query("directory_decisions", "docs", f"SELECT lang AS directory, id, r AS rank FROM (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY modified_at DESC, id) AS r FROM docs WHERE content_type = 'decision' AND active AND (epoch(TIMESTAMP '{NOW}') - epoch(modified_at)) / 86400 <= 120) WHERE r <= 5")
def directory_decisions(t: Tables) -> DataFrame:
    """Each directory's latest decisions."""
    from ..functions import time as Time

    d = t.documents.where("content_type = 'decision' and active").where(Time.age_days(F.col("modified_at"), NOW) <= 120)
    w = Window.partitionBy("lang").orderBy(F.desc("modified_at"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(F.col("lang").alias("directory"), "id", "rank")


@query("profile_facts", "docs", "WITH f AS (SELECT collection, id, trim(title) AS fact, row_number() OVER (PARTITION BY collection, lower(substring(trim(title), 1, 60)) ORDER BY CASE content_type WHEN 'decision' THEN 0 ELSE 1 END, modified_at DESC, id) AS k, CASE content_type WHEN 'decision' THEN 0 ELSE 1 END AS p, modified_at FROM docs WHERE active AND content_type IN ('decision', 'hub')), g AS (SELECT *, row_number() OVER w AS r, sum(length(fact)) OVER w AS total FROM f WHERE k = 1 WINDOW w AS (PARTITION BY collection ORDER BY p, modified_at DESC, id ROWS UNBOUNDED PRECEDING)) SELECT collection, id, fact FROM g WHERE r <= 30 AND (r = 1 OR total <= 2000)")
def profile_facts(t: Tables) -> DataFrame:
    """A profile: decisions, then hubs, each fact once, at most 30 and 2000 characters."""
    order = [F.when(F.col("content_type") == "decision", 0).otherwise(1), F.desc("modified_at"), "id"]
    d = t.documents.where("active and content_type in ('decision', 'hub')").withColumn("fact", F.trim("title")).withColumn("k", F.lower(F.substring("fact", 1, 60)))
    once = fusion.first_wins(d, ["collection", "k"], order).withColumn("n", F.length("fact"))
    kept = fusion.within_budget(once, "collection", order, "n", 2000)
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("collection").orderBy(*order))).where("r <= 30").select("collection", "id", "fact")
