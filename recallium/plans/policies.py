"""Queries of what is shown and how it is ranked: blends, visibility, clauses, caps, names of paths, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import chains, fts, graph, vector
from ..sources.tables import Tables, sql
from . import guards, search, textual
from .search import r6

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def scored(t: Tables, most: int) -> DataFrame:
    """(query_id, doc_id, score, rerank, rank): the best by words, with the share of terms as the reranker's score."""
    found = search.matches(t, best={"score": most}).select("query_id", "doc_id", fts.bounded_score(F.col("bm25")).alias("score"), (F.col("hit") / F.col("n_terms")).alias("rerank"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


_SCORED_SQL = f"{search.BM25_SQL}, s AS (SELECT query_id, doc_id, bm25 / (1 + bm25) AS score, hit / n_terms AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25 / (1 + bm25), 9) DESC, doc_id) AS rank FROM found)"


@query("causal_blend", "docs", f"WITH {_SCORED_SQL} SELECT query_id, doc_id, round(CASE WHEN rank <= 3 THEN 0.75 * score + 0.25 * rerank WHEN rank <= 10 THEN 0.6 * score + 0.4 * rerank ELSE 0.4 * score + 0.6 * rerank END, 6) AS score FROM s WHERE rank <= 30")
def causal_blend(t: Tables) -> DataFrame:
    """The best thirty, blended with a reranker the more, the farther down they stand."""
    own = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.6).otherwise(0.4)
    return scored(t, 30).select("query_id", "doc_id", r6(own * F.col("score") + (1 - own) * F.col("rerank")).alias("score"))


@query("surfacing_blend", "docs", f"WITH {_SCORED_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM s WHERE rank <= 40) SELECT query_id, doc_id, round(CASE WHEN n >= 3 AND rank <= 15 THEN 0.6 * score + 0.4 * rerank ELSE score END, 6) AS score FROM n")
def surfacing_blend(t: Tables) -> DataFrame:
    """What a prompt is given: the first fifteen blended with a reranker if there are three at least, the rest as they are."""
    n = F.count("*").over(Window.partitionBy("query_id"))  # forty rows a query at most
    d = scored(t, 40).withColumn("n", n)
    return d.select("query_id", "doc_id", r6(F.when((F.col("n") >= 3) & (F.col("rank") <= 15), 0.6 * F.col("score") + 0.4 * F.col("rerank")).otherwise(F.col("score"))).alias("score"))


@query("scoring_regimes", "", f"SELECT conv_id, turn, CASE WHEN coalesce(regexp_matches(text, '{intent.any_of(intent.RECENT)}'), false) THEN 'recency-composite' ELSE 'raw' END AS regime FROM conversations")
def scoring_regimes(t: Tables) -> DataFrame:
    """Questions for what is recent are ranked by the composite score, all others by the raw one."""
    return t.conversations.select("conv_id", "turn", F.when(F.coalesce(intent.wants_recent(F.col("text")), F.lit(False)), "recency-composite").otherwise("raw").alias("regime"))


@query("exchange_titles", "", r"WITH f AS (SELECT conv_id, turn, regexp_replace(split_part(text, chr(10), 1), '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS line FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN length(line) <= 80 THEN line ELSE substring(line, 1, 77) || '...' END AS title FROM f")
def exchange_titles(t: Tables) -> DataFrame:
    """The first line of what the user says, of eighty characters at most."""
    line = T.stripped(F.split_part("text", F.lit("\n"), F.lit(1)))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", line.alias("line")).select("conv_id", "turn", F.when(F.length("line") <= 80, F.col("line")).otherwise(F.concat(F.substring("line", 1, 77), F.lit("..."))).alias("title"))


# What shows that a question has several topics.
MANY_TOPICS = [r"\band\s+(?:also|what|how|why)\b", r"\bboth\s+.+\s+and\s+", r"\?.*\?", r"\b(?:plus|additionally|as well as|along with)\b"]
_MANY = "|".join(MANY_TOPICS)


def clauses(text: Column) -> Column:
    """(type, priority) of the ways to ask: by graph for causes and names, else by words, and by vector; a long
    question of several topics, which only a model could take apart, by words and vector at once."""
    long_words = F.size(F.filter(F.split(text, r"[\t-\r ]+"), lambda w: F.length(w) > 2))
    several = (long_words > 5) & text.rlike("(?i)" + T.ascii_words(_MANY))
    way = F.when(~several & T.intent(text)["intent"].isin("WHY", "ENTITY"), "graph").otherwise("bm25")
    return F.array(F.struct(way.alias("type"), F.lit(1).alias("priority")), F.struct(F.lit("vector").alias("type"), F.when(several, 2).otherwise(3).alias("priority")))


@query(
    "query_clauses", "",
    f"""WITH p AS (SELECT conv_id, turn, text, {', '.join(f'{v} AS "{k}"' for k, v in textual._POINTS.items())} FROM conversations WHERE text IS NOT NULL), m AS (SELECT *, greatest("WHY", "WHEN", "ENTITY") AS top FROM p),
    i AS (SELECT conv_id, turn, top > 0 AND ("WHY" = top OR ("ENTITY" = top AND "WHEN" <> top)) AS linked, len(list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda w: length(w) > 2)) > 5 AND regexp_matches(text, '(?i){_MANY}') AS several FROM m)
    SELECT conv_id, turn, CASE WHEN linked AND NOT several THEN 'graph' ELSE 'bm25' END AS type, 1 AS priority FROM i UNION ALL SELECT conv_id, turn, 'vector', CASE WHEN several THEN 2 ELSE 3 END FROM i""",
)
def query_clauses(t: Tables) -> DataFrame:
    return t.conversations.where("text is not null").select("conv_id", "turn", F.inline(clauses(F.col("text"))))


INTERNAL = ["src0"]


@query(
    "visible_documents", "docs",
    "WITH r AS (SELECT * FROM (VALUES ('default', false, NULL), ('internal', true, NULL), ('named', false, 'src0'), ('other', false, 'src1')) AS v(request, include_internal, wanted)) SELECT request, count(*) AS n FROM r JOIN docs ON active AND NOT invalidated AND (wanted IS NULL OR collection = wanted) AND (include_internal OR coalesce(wanted = 'src0', false) OR collection <> 'src0') GROUP BY request",
)
def visible_documents(t: Tables) -> DataFrame:
    """How many documents four requests may see: internal collections are hidden unless asked for or named."""
    requests = [("default", False, None), ("internal", True, None), ("named", False, ["src0"]), ("other", False, ["src1"])]
    seen = [visible(t.documents.where("active and not invalidated"), include, wanted).select(F.lit(name).alias("request")) for name, include, wanted in requests]
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out.groupBy("request").agg(F.count("*").alias("n"))


def visible(docs: DataFrame, include_internal: bool = False, wanted: list[str] | None = None, internal: list[str] = INTERNAL) -> DataFrame:
    """Documents of the collections wanted, without internal ones unless they are asked for or one is named."""
    d = docs.where(F.col("collection").isin(wanted)) if wanted else docs
    return d if include_internal or set(wanted or ()) & set(internal) else d.where(~F.col("collection").isin(internal))


CAP, ENVELOPE = 300, 40


@query("wire_capped_edges", "recall", f"WITH {guards._WITHIN_SQL}, l AS (SELECT set_id, n, octet_length(encode(format('doc#{{}} --[{{}} w={{:.2f}}]--> doc#{{}}', source_id, relation_type, weight, target_id))) + 1 AS bytes FROM met WHERE n <= 10), s AS (SELECT *, sum(bytes) OVER (PARTITION BY set_id ORDER BY n) AS total FROM l) SELECT set_id, count(*) FILTER (total + {ENVELOPE} <= {CAP}) AS kept, bool_or(total + {ENVELOPE} > {CAP}) AS truncated FROM s GROUP BY set_id")
def wire_capped_edges(t: Tables) -> DataFrame:
    """How many lines of each set's context fit within a number of bytes; the last go first."""
    e = chains.edges_within(guards.sets(t), search.edges(t))
    line = F.octet_length(F.format_string("doc#%d --[%s w=%.2f]--> doc#%d", "source_id", "relation_type", "weight", "target_id")) + 1
    total = F.sum("bytes").over(Window.partitionBy("set_id").orderBy("n"))  # ten rows a set at most
    fits = F.col("total") + ENVELOPE <= CAP
    return e.select("set_id", "n", line.alias("bytes")).withColumn("total", total).groupBy("set_id").agg(F.count_if(fits).alias("kept"), F.max(~fits).alias("truncated"))


@query("cooccurrence_totals", "mentions", "WITH p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL), e AS (SELECT DISTINCT entity FROM mentions) SELECT entity, coalesce(sum(n), 0)::BIGINT AS total FROM e LEFT JOIN (SELECT a AS entity, n FROM p UNION ALL SELECT b, n FROM p) USING (entity) GROUP BY entity")
def cooccurrence_totals(t: Tables) -> DataFrame:
    """How often an entity is mentioned beside another one, in all."""
    p = graph.pair_counts(t.mentions, "doc_id", "entity")
    both = p.select(F.col("a").alias("entity"), "n").unionByName(p.select(F.col("b").alias("entity"), "n")).groupBy("entity").agg(F.sum("n").alias("n"))
    return t.mentions.select("entity").distinct().join(both, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("total"))


@query("hydrated_hashes", "docs", "SELECT hash, min(id) AS doc_id, arg_min(title, id) AS title, count(*) AS copies FROM docs WHERE active GROUP BY hash")
def hydrated_hashes(t: Tables) -> DataFrame:
    """The first active document of each content."""
    return t.documents.where("active").groupBy("hash").agg(F.min("id").alias("doc_id"), F.min_by("title", "id").alias("title"), F.count("*").alias("copies"))


@query("surprising_batch", "vectors", f"WITH s AS (SELECT query_id AS doc_id, round(avg(1 - similarity), 6) AS surprisal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS r FROM (SELECT a.doc_id AS query_id, b.doc_id, {search._SIM} AS similarity FROM vectors a JOIN vectors b ON a.doc_id <> b.doc_id)) WHERE r <= 6 AND 1 - similarity > 0.001 GROUP BY query_id) SELECT doc_id, surprisal FROM s ORDER BY surprisal DESC, doc_id LIMIT 15")
def surprising_batch(t: Tables) -> DataFrame:
    """The documents farthest from what lies nearest to them."""
    return vector.surprisal(t.vectors, 5).withColumn("surprisal", r6(F.col("surprisal"))).orderBy(F.desc("surprisal"), "doc_id").limit(15)


def path_slug(path: Column) -> Column:
    """A path of names in letters and digits joined by hyphens, lower-cased; ___ divides folders, the ending
    stays; null where the name has no letter or digit."""
    parts = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    last = F.element_at(parts, -1)
    ending = F.regexp_extract(last, r"(\.[a-z0-9]+)$", 1)
    name = F.concat(clean(F.substring(last, F.lit(1), F.length(last) - F.length(ending))), ending)
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), clean)
    joined = F.array_join(F.filter(F.concat(folders, F.array(name)), lambda s: s != ""), "/")
    own = F.regexp_replace(F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1), r"\.[^.]+$", "")
    return F.when(own.rlike(r"[\p{L}\p{N}]"), joined)


_CLEAN = r"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "path_slugs", "docs",
    rf"""WITH n AS (SELECT id, lower(collection || '___' || title) || '.md' AS p FROM docs), s AS (SELECT id, string_split(replace(p, '___', '/'), '/') AS s, p FROM n)
    SELECT id, CASE WHEN regexp_matches(regexp_replace(list_last(list_filter(string_split(p, '/'), lambda x: x <> '')), '\.[^.]+$', ''), '[\p{{L}}\p{{N}}]') THEN array_to_string(list_filter(list_append(list_transform(s[1:-2], lambda x: {_CLEAN.format(x='x')}), {_CLEAN.format(x="regexp_replace(s[-1], '[.]md$', '')")} || '.md'), lambda x: x <> ''), '/') END AS slug FROM s""",
)
def path_slugs(t: Tables) -> DataFrame:
    """Paths made of collections and titles, as names of files."""
    named = F.concat(F.lower(F.concat("collection", F.lit("___"), "title")), F.lit(".md"))
    return t.documents.select("id", path_slug(named).alias("slug"))


def to_virtual(paths: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """``paths`` (id, absolute) with ``uri``: the virtual path of an active document (collection, path) under the
    longest root (collection, root) above it; null where there is none. Every folder above a path meets roots by
    equality, so nothing is compared by prefix."""
    parts = F.split("absolute", "/")
    above = paths.select("id", "absolute", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    met = above.join(roots, "root").withColumn("path", F.expr("substring(absolute, length(root) + 2)"))
    held = met.join(docs.select("collection", "path").distinct(), ["collection", "path"], "left_semi")
    best = held.groupBy("id").agg(F.max(F.struct(F.length("root").alias("n"), "collection", "path")).alias("b"))
    return paths.select("id").join(best, "id", "left").select("id", F.when(F.col("b").isNotNull(), T.virtual_path(F.col("b.collection"), F.col("b.path"))).alias("uri"))


@query("virtual_paths", "docs", "SELECT id, CASE WHEN active AND id % 3 <> 0 THEN 'memory://' || collection || '/' || path END AS uri FROM docs")
def virtual_paths(t: Tables) -> DataFrame:
    """Absolute paths of documents, every third of them outside of all roots."""
    d = t.documents
    paths = d.select("id", F.concat(F.when(F.col("id") % 3 == 0, "/other/").otherwise("/data/"), "collection", F.lit("/"), "path").alias("absolute"))
    roots = d.select("collection", F.concat(F.lit("/data/"), "collection").alias("root")).distinct()
    return to_virtual(paths, roots, d.where("active"))
