"""Queries of names in conclusions, similar observations, chains of supersession, and sets of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import automaton, cascade, chains, fts, setjoin, vector
from ..sources.shared import written
from ..sources.tables import Tables, sql
from . import search, textual

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


#: Capitalised words of five letters or more are the names that texts mention.
NAME = r"\b[A-Z][a-z]{4,}\b"
_NAMES_SQL = f"mentioned AS (SELECT DISTINCT doc_id, source, lower(unnest(regexp_extract_all(coalesce(text, ''), '{NAME}'))) AS name FROM documents)"


def mentioned(t: Tables) -> DataFrame:
    """(doc_id, source, name) of every name in a document."""
    d = t.raw("documents").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.ascii_words(NAME)), F.lit(0)))).alias("name"))
    return d.select("doc_id", "source", F.lower("name").alias("name")).distinct()


@query(
    "contaminated_conclusions", "",
    f"""WITH {_NAMES_SQL}, pool AS (SELECT DISTINCT source, name FROM mentioned), said AS (SELECT conv_id, turn, source, lower(c.text) AS t FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)
    SELECT DISTINCT conv_id, turn, p.name FROM said s JOIN pool p ON p.source = s.source AND contains(t, p.name) AND regexp_matches(t, '(^|[^a-z0-9])' || p.name || '($|[^a-z0-9])') WHERE NOT EXISTS (SELECT 1 FROM mentioned m WHERE m.doc_id = s.conv_id AND m.name = p.name)""",
)
def contaminated_conclusions(t: Tables) -> DataFrame:
    """Names in a turn that documents of its document's source mention, but that document doesn't."""
    names = mentioned(t)
    said = t.conversations.join(t.raw("documents").select(F.col("doc_id").alias("conv_id"), "source"), "conv_id")
    hits = automaton.scan(said, names, ["conv_id", "turn", "source"])
    known = hits.join(names.select("source", "name").distinct(), ["source", "name"], "left_semi")
    return known.join(names.select(F.col("doc_id").alias("conv_id"), "name"), ["conv_id", "name"], "left_anti").select("conv_id", "turn", "name").distinct()


_LONG = r"list_filter(list_distinct(string_split_regex(lower({x}), '[\t-\r ]+')), lambda w: length(w) > 3)"


@query(
    "similar_observations", "docs",
    f"""WITH o AS (SELECT id, lang AS block, {_LONG.format(x='body')} AS w FROM docs WHERE active),
    p AS (SELECT a.id AS new_id, b.id AS held_id, b.w AS hw, len(list_intersect(a.w, b.w)) AS both_, len(a.w) AS m, len(b.w) AS n FROM o a JOIN o b ON a.block = b.block AND a.id % 2 = 1 AND b.id % 2 = 0 AND len(a.w) > 0 AND len(b.w) > 0 AND 2 * len(a.w) > len(b.w) AND 2 * len(b.w) > len(a.w))
    SELECT new_id, held_id, round(jaccard, 6) AS jaccard FROM (SELECT new_id, min(held_id) AS held_id, both_ / (m + n - both_) AS jaccard FROM p WHERE 2 * both_ > m + n - both_ GROUP BY new_id, list_sort(hw), both_, m, n)""",
)
def similar_observations(t: Tables) -> DataFrame:
    """Every other document as a new observation, and those of its language that share more than half of their words; of equal ones the first."""
    o = t.texts.where("active").select("id", F.col("lang").alias("block"), setjoin.long_words(F.col("body")).alias("words"))
    found = setjoin.similar(o.where("id % 2 = 1"), o.where("id % 2 = 0"), 0.5)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "low_confidence_duplicates", "docs",
    f"""WITH o AS (SELECT id, lang AS block, confidence, {_LONG.format(x='body')} AS w FROM docs WHERE active AND NOT invalidated),
    p AS (SELECT a.id, b.id AS kept, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM o a JOIN o b ON a.block = b.block AND a.id <> b.id AND a.confidence < 0.4 AND b.confidence >= 0.4 AND len(a.w) > 0 AND len(b.w) > 0)
    SELECT id, kept, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(jaccard, 9) DESC, kept) AS r FROM p WHERE jaccard >= 0.4 - 1e-9) WHERE r = 1""",
)
def low_confidence_duplicates(t: Tables) -> DataFrame:
    """Documents of little confidence with the one of their language that says most of the same and is to be kept."""
    o = t.documents.where("active and not invalidated").select("id", F.col("lang").alias("block"), "confidence", setjoin.long_words(F.col("body")).alias("words"))
    found = setjoin.similar(o.where("confidence < 0.4"), o.where("confidence >= 0.4"), 0.4 - 1e-9)
    best = found.groupBy(F.col("new_id").alias("id")).agg(F.max(F.struct(F.round("jaccard", 9).alias("j"), (-F.col("held_id")).alias("kept"))).alias("b"))
    return best.select("id", (-F.col("b.kept")).alias("kept"), F.round("b.j", 6).alias("jaccard"))


def followed(t: Tables) -> DataFrame:
    """(id, next): an order and the customer's next one, as what takes its place."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"))


@query(
    "superseding_members", "",
    """WITH RECURSIVE links AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders),
    walk(id, reached, steps) AS (SELECT id, next, 1 FROM links WHERE next IS NOT NULL UNION ALL SELECT w.id, l.next, steps + 1 FROM walk w JOIN links l ON l.id = w.reached WHERE l.next IS NOT NULL),
    ends AS (SELECT id, arg_max(reached, steps) AS last, max(steps) AS steps FROM walk GROUP BY id)
    SELECT id, last, steps::BIGINT AS steps, false AS cyclic FROM ends UNION ALL SELECT DISTINCT next, next, 0, false FROM links WHERE next IS NOT NULL AND next NOT IN (SELECT id FROM links WHERE next IS NOT NULL)""",
)
def superseding_members(t: Tables) -> DataFrame:
    """What each superseded member of a chain was superseded by in the end, and how many steps away."""
    return chains.last_members(followed(t))


@query(
    "contradictions_applied", "",
    """WITH h AS (SELECT o_orderkey AS id, o_custkey, 'active' AS status FROM orders), f AS (SELECT o_orderkey AS old_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new_id, o_orderstatus = 'F' AS ends FROM orders)
    SELECT id, CASE WHEN ends THEN 'inactive' ELSE status END AS status, new_id AS invalidated_by, CASE WHEN ends THEN new_id END AS superseded_by FROM h LEFT JOIN (SELECT * FROM f WHERE new_id IS NOT NULL) f ON old_id = id""",
)
def contradictions_applied(t: Tables) -> DataFrame:
    """Orders as observations of a customer: a finished one is superseded by the next, others are linked to it."""
    o = t.raw("orders")
    held = o.select(F.col("o_orderkey").alias("id"), F.lit("active").alias("status"), *(F.lit(None).cast(k).alias(c) for c, k in (("invalidated_by", "long"), ("superseded_by", "long"), ("invalidated_at", "timestamp"))))
    policy = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "supersede").otherwise("link").alias("policy"))
    found = followed(t).where("next is not null").join(policy, "id").select(F.col("id").alias("old_id"), F.col("next").alias("new_id"), "policy")
    return chains.apply_contradictions(held, found, F.current_timestamp()).drop("invalidated_at")


_SETS_SQL = "sets AS (SELECT DISTINCT l_orderkey % 500 AS set_id, l_partkey % 200 AS doc_id FROM lineitem)"


def sets(t: Tables) -> DataFrame:
    """Overlapping sets of documents: what five hundred baskets hold."""
    return t.raw("lineitem").select((F.col("l_orderkey") % 500).alias("set_id"), (F.col("l_partkey") % 200).alias("doc_id")).distinct()


_WITHIN_SQL = f"{search._EDGES_SQL}, {_SETS_SQL}, met AS (SELECT a.set_id, e.*, row_number() OVER (PARTITION BY a.set_id ORDER BY weight DESC, source_id, target_id, relation_type) AS n FROM edges e JOIN sets a ON a.doc_id = source_id JOIN sets b ON b.doc_id = target_id AND b.set_id = a.set_id)"


@query("edges_within_sets", "recall", f"WITH {_WITHIN_SQL} SELECT set_id, source_id, target_id, relation_type, weight, n FROM met WHERE n <= 10")
def edges_within_sets(t: Tables) -> DataFrame:
    """The ten heaviest edges among the documents of every set."""
    return chains.edges_within(sets(t), search.edges(t))


@query("source_relation_context", "recall", f"WITH {_WITHIN_SQL} SELECT set_id, string_agg(format('doc#{{}} --[{{}} w={{:.2f}}]--> doc#{{}}', source_id, relation_type, weight, target_id), chr(10) ORDER BY n) AS context FROM met WHERE n <= 10 GROUP BY set_id")
def source_relation_context(t: Tables) -> DataFrame:
    """The same as text."""
    return chains.relation_context(chains.edges_within(sets(t), search.edges(t)))


@query("source_entity_anchors", "mentions", f"WITH {_SETS_SQL} SELECT DISTINCT set_id, entity FROM sets JOIN mentions USING (doc_id)")
def source_entity_anchors(t: Tables) -> DataFrame:
    """The entities that the documents of a set mention."""
    return chains.anchors_of_sets(sets(t), t.mentions)


@query(
    "link_targets", "docs",
    r"""WITH names AS (SELECT collection, id AS doc_id, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS key FROM docs WHERE active UNION SELECT collection, id, regexp_replace(trim(lower(split_part(title, ' ', 1))), '\s+', ' ', 'g') FROM docs WHERE active),
    alone AS (SELECT collection, key, min(doc_id) AS target FROM names WHERE key <> '' GROUP BY ALL HAVING min(doc_id) = max(doc_id)), n AS (SELECT collection, key, count(DISTINCT doc_id) AS n FROM names WHERE key <> '' GROUP BY ALL)
    SELECT d.id, target, coalesce(n.n, 0) AS owners FROM (SELECT id, collection, regexp_replace(trim(lower(split_part(title, ' ', 1))), '\s+', ' ', 'g') AS key FROM docs) d LEFT JOIN alone USING (collection, key) LEFT JOIN n USING (collection, key)""",
)
def link_targets(t: Tables) -> DataFrame:
    """The document that each document's first title word leads to within its collection, if it is the only one."""
    first = intent.title_key(F.split_part("title", F.lit(" "), F.lit(1)))
    d = t.documents
    names = d.where("active").select("collection", F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.array(intent.title_key(F.col("title")), first))).alias("key"))
    links = d.select("id", "collection", first.alias("key"))
    owners = names.where("key <> ''").groupBy("collection", "key").agg(F.count_distinct("doc_id").alias("n"))
    return chains.link_targets(links, names).join(owners, ["collection", "key"], "left").select("id", "target", F.coalesce("n", F.lit(0)).alias("owners"))


_TOK = textual.TOK
_MEANT_SQL = f"""live AS (SELECT id AS doc_id, collection || '/' || path AS place, title, modified_at FROM docs WHERE active AND NOT invalidated),
q AS (SELECT id AS query_id, CASE id // 25 % 4 WHEN 0 THEN path WHEN 1 THEN array_to_string({_TOK.format(x='body')}[5:8], ' ') WHEN 2 THEN array_to_string({_TOK.format(x='title')}[1:4], ' ') || ' zzqx zzqy' ELSE 'zzqw' || id END AS query FROM docs WHERE id % 25 = 0),
pathed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q JOIN live ON contains(lower(place), lower(regexp_replace(query, '^/', ''))) WHERE contains(query, '/') OR suffix(query, '.md')),
left1 AS (SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM pathed)),
{search.BM25_SQL.replace(search.BM25_SQL[: search.BM25_SQL.index("qd AS")], "questions AS (SELECT query_id, query FROM left1)," + chr(10))},
f AS (SELECT query_id, doc_id, bm25 / (1 + bm25) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25 / (1 + bm25), 9) DESC, doc_id) AS rank FROM found WHERE hit = n_terms),
left2 AS (SELECT * FROM left1 WHERE query_id NOT IN (SELECT query_id FROM f)),
tw AS (SELECT query_id, list_filter(list_transform(list_filter(string_split_regex(lower(query), '[\t-\r ]+'), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in cascade.STOPWORDS)})), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 2) AS w FROM left2),
tm AS (SELECT query_id, doc_id, modified_at, len(w) AS n, len(list_filter(w, lambda x: contains(lower(title), x))) AS hit FROM tw, live WHERE len(w) > 0),
h AS (SELECT query_id, doc_id, hit / n AS score, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, modified_at DESC, doc_id) AS rank FROM tm WHERE hit >= greatest(2, ceil(n / 2))),
left3 AS (SELECT * FROM left2 WHERE query_id NOT IN (SELECT query_id FROM h)),
v AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT l.query_id, b.doc_id, {search._SIM} AS score FROM left3 l JOIN vectors a ON a.doc_id = l.query_id JOIN vectors b ON b.doc_id <> a.doc_id WHERE b.doc_id IN (SELECT doc_id FROM live))),
meant AS (SELECT query_id, doc_id, 1.0 - (rank - 1) * 0.05 AS score, 'path' AS source, rank FROM pathed WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, score, 'fts', rank FROM f WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, score, 'title', rank FROM h WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, score, 'vec', rank FROM v WHERE rank <= 5)"""


def asked(t: Tables) -> DataFrame:
    """What users might say to mean a document: its path, words of its text, of its title among others, or none of its words."""
    d = t.documents.where("id % 25 = 0")
    kind, words, title = F.floor(F.col("id") / 25) % 4, T.tokens(F.col("body")), T.tokens(F.col("title"))
    said = F.when(kind == 0, F.col("path")).when(kind == 1, F.array_join(F.slice(words, 5, 4), " ")).when(kind == 2, F.concat(F.array_join(F.slice(title, 1, 4), " "), F.lit(" zzqx zzqy"))).otherwise(F.concat(F.lit("zzqw"), F.col("id").cast("string")))
    return d.select(F.col("id").alias("query_id"), said.alias("query"))


def meant(t: Tables) -> DataFrame:
    live = t.documents.where("active and not invalidated").select(F.col("id").alias("doc_id"), F.concat_ws("/", "collection", "path").alias("place"), "title", "modified_at")
    index = search.live_index(t)

    def by_words(queries: DataFrame) -> DataFrame:
        return fts.search(queries, index.by_document(), stats=index.body_statistics(), best={"score": cascade.LIMIT}).select("query_id", "doc_id", fts.bounded_score(F.col("bm25")).alias("score"))

    def by_vector(queries: DataFrame) -> DataFrame:
        own = t.vectors.join(queries.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
        return vector.knn(own, t.vectors.join(live, "doc_id", "left_semi"), cascade.LIMIT).select("query_id", "doc_id", F.col("similarity").alias("score"))

    return cascade.candidates(asked(t), live, by_words, by_vector, written)


@query("lifecycle_candidates", "docs vectors", f"WITH {_MEANT_SQL} SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, source, rank::INTEGER AS rank FROM meant")
def lifecycle_candidates(t: Tables) -> DataFrame:
    """What users mean to change, by the first way that finds anything."""
    return meant(t).withColumn("score", F.round("score", 6))


@query(
    "lifecycle_targets", "docs vectors",
    f"""WITH {_MEANT_SQL}, b AS (SELECT q.query_id, a.doc_id, coalesce(a.score >= 0.7 OR round(a.score - s.score, 9) >= 0.2, false) AS confident FROM q LEFT JOIN meant a ON a.query_id = q.query_id AND a.rank = 1 LEFT JOIN meant s ON s.query_id = q.query_id AND s.rank = 2)
    SELECT query_id, doc_id, confident, CASE WHEN doc_id IS NULL THEN 'not found' ELSE 'target' END AS outcome, CASE WHEN doc_id IS NULL THEN 'not found' WHEN confident THEN 'target' ELSE 'ambiguous' END AS outcome_if_destructive FROM b""",
)
def lifecycle_targets(t: Tables) -> DataFrame:
    """Which document is meant, and whether it is certain enough to be forgotten."""
    return cascade.targets(asked(t), meant(t))
