"""Queries of extraction, chunking, contradiction and merging, each with its SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, extract, judge
from ..sources.tables import Tables, sql
from . import textual

QUERIES, ORACLE = {}, {}


def query(name: str, uses: str = "", body: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if body:
            ORACLE[name] = sql(uses, body)
        return f

    return add


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(regexp_replace({x}, '([.!?])[ \t]+', '\1' || chr(1), 'g'), '\n', chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)"


_STRIP = r"regexp_replace({x}, '^[\t-\r ]+|[\t-\r ]+\z', '', 'g')"
_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM transcripts)"


def _statements(pattern: str, parts: str, least: int, most: int, prefix: int, limit: int = 1 << 60, last: int = 1 << 60) -> str:
    return f"""WITH z AS (SELECT conv_id, turn, {parts} AS s FROM {_NEWEST} WHERE role = 'assistant' AND back <= {last}),
    e AS (SELECT conv_id, turn, unnest(range(len(s))) AS place, unnest(s) AS said, unnest(list_concat([''], s)[:len(s)]) AS b FROM z),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(substring(said, 1, {prefix})) ORDER BY turn, place) AS n FROM e WHERE length(said) BETWEEN {least} AND {most} AND regexp_matches(said, {_quoted(pattern)})),
    g AS (SELECT conv_id, turn, place, {_STRIP.format(x='said')} AS sentence, {_STRIP.format(x='b')} AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS k FROM f WHERE n = 1),
    h AS (SELECT conv_id, turn, place, sentence, before FROM g WHERE k <= {limit})"""


_AFTER_SENTENCES = r"string_split(regexp_replace(text, '([.!?])[\t-\r ]+', '\1' || chr(1), 'g'), chr(1))"
_AFTER_CLAUSES = r"string_split(regexp_replace(text, '[.!][\t-\r ]+', chr(1), 'g'), chr(1))"


@query("extract_decisions", "transcripts", _statements(extract.DECISIONS, _AFTER_SENTENCES, 20, 500, 80) + " SELECT conv_id, turn, place, sentence, coalesce((SELECT arg_max(substring(u.text, 1, 200), u.turn) FROM transcripts u WHERE u.role = 'user' AND u.conv_id = h.conv_id AND u.turn >= h.turn - 3 AND u.turn < h.turn), '') AS context FROM h")
def extract_decisions(t: Tables) -> DataFrame:
    return extract.decisions(t.transcripts)


@query("extract_antipatterns", "transcripts", _statements(extract.ANTIPATTERNS, _AFTER_CLAUSES, 15, 500, 80, 10) + " SELECT conv_id, turn, place, sentence, before AS context FROM h")
def extract_antipatterns(t: Tables) -> DataFrame:
    return extract.antipatterns(t.transcripts)


@query("extract_actions", "transcripts", _statements(extract.ACTIONS, _AFTER_SENTENCES, 15, 300, 60, 10) + " SELECT conv_id, turn, place, sentence FROM h")
def extract_actions(t: Tables) -> DataFrame:
    return extract.actions(t.transcripts)


@query("extract_next_steps", "transcripts", _statements(extract.NEXT_STEPS, _AFTER_SENTENCES, 15, 300, 60, 5, 30) + " SELECT conv_id, turn, place, sentence FROM h")
def extract_next_steps(t: Tables) -> DataFrame:
    return extract.next_steps(t.transcripts)


_ASKED = "list_concat(" + ", ".join(f"regexp_extract_all(text, {_quoted(p)})" for p in extract.QUESTIONS) + ")"


@query("extract_open_questions", "transcripts", f"WITH z AS (SELECT conv_id, turn, {_ASKED} AS s FROM {_NEWEST} WHERE back <= 20), e AS (SELECT conv_id, turn, unnest(range(len(s))) AS place, {_STRIP.format(x='unnest(s)')} AS sentence FROM z), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(substring(sentence, 1, 60)) ORDER BY turn, place) AS n FROM e WHERE length(sentence) BETWEEN 16 AND 299), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS k FROM f WHERE n = 1) SELECT conv_id, turn, place, sentence FROM g WHERE k <= 10")
def extract_open_questions(t: Tables) -> DataFrame:
    return extract.open_questions(t.transcripts)


_FILES = "list_concat(" + ", ".join(f"regexp_extract_all(text, {_quoted(p)}, 1)" for p in extract.CHANGED_FILES) + ")"


@query("changed_files", "transcripts", f"SELECT DISTINCT conv_id, file FROM (SELECT conv_id, unnest({_FILES}) AS file FROM transcripts WHERE role = 'assistant') WHERE NOT contains(file, '*') AND length(file) < 200")
def changed_files(t: Tables) -> DataFrame:
    return extract.changed_files(t.transcripts)


@query("last_requests", "transcripts", "SELECT conv_id, arg_max(substring(text, 1, 500), turn) AS request FROM transcripts WHERE role = 'user' AND length(text) > 10 GROUP BY conv_id")
def last_requests(t: Tables) -> DataFrame:
    return extract.last_requests(t.transcripts)


@query("extract_topics", "", "WITH f AS (SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS topic FROM conversations WHERE role = 'user'), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(substring(topic, 1, 50)) ORDER BY turn) AS n FROM f WHERE length(topic) BETWEEN 10 AND 200 AND NOT starts_with(topic, '/')), h AS (SELECT conv_id, turn, topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM g WHERE n = 1) SELECT conv_id, turn, topic FROM h WHERE k <= 5")
def extract_topics(t: Tables) -> DataFrame:
    return extract.topics(t.conversations)


@query("extract_paths", "", f"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, {_quoted(extract.FILE_PATH)}))), ' ') AS paths FROM pages")
def extract_paths(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.array_join(F.array_sort(extract.distinct_matches(F.col("url"), extract.FILE_PATH)), " ").alias("paths"))


@query("extract_proper_nouns", "docs", f"SELECT id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(body, '{extract.WORD}')), lambda w: regexp_matches(w, {_quoted(extract.PROPER_NOUN)}))), ' ') AS names FROM docs")
def extract_proper_nouns(t: Tables) -> DataFrame:
    return t.documents.select("id", F.array_join(F.array_sort(extract.distinct_words(F.col("body"), extract.PROPER_NOUN)), " ").alias("names"))


@query("extract_bullets", "docs", r"SELECT id, len(list_filter(list_transform(list_filter(string_split(body, chr(10)), lambda s: regexp_matches(s, '^\s*[-*] ')), lambda s: regexp_replace(s, '^\s*[-*] ', '')), lambda s: length(s) BETWEEN 10 AND 200)) AS n FROM docs")
def extract_bullets(t: Tables) -> DataFrame:
    return t.documents.select("id", F.size(extract.bullets(F.col("body"))).cast("long").alias("n"))


@query("text_windows", "docs", "WITH s AS (SELECT id, body, unnest(range(0, greatest(length(body) - 200, 1), 3800)) AS start FROM docs) SELECT id, start, sha256(substring(body, start + 1, 4000)) AS piece FROM s")
def text_windows(t: Tables) -> DataFrame:
    w = t.documents.select("id", F.explode(chunk.windows(F.col("body"), 4000, 200)).alias("w"))
    return w.select("id", F.col("w.start").cast("long").alias("start"), F.sha2("w.piece", 256).alias("piece"))


@query("chunks")
def chunks(t: Tables) -> DataFrame:
    return chunk.explode_chunks(t.documents)


@query("token_chunks")
def token_chunks(t: Tables) -> DataFrame:
    """Chunks of at most 800 tokens that share 120."""
    return chunk.explode_token_chunks(t.documents)


@query("fragments")
def fragments(t: Tables) -> DataFrame:
    return chunk.explode_fragments(t.documents)


_NOT_NAMES = ", ".join(f"'{w}'" for w in T.NOT_NAMES)
_NEG = r"regexp_matches(lower({x}), '(^|[^a-z])(not|no|never|none|cannot|without|nicht|kein|pas|jamais|nunca)([^a-z]|$)')"
_NUM = r"list_transform(regexp_extract_all({x}, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda n: replace(n, ',', ''))"


@query("contradictions", "", f"WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CASE WHEN {_NEG.format(x='x')} <> {_NEG.format(x='y')} THEN 0.6 WHEN len({_NUM.format(x='x')}) > 0 AND len({_NUM.format(x='y')}) > 0 AND NOT list_has_any({_NUM.format(x='x')}, {_NUM.format(x='y')}) THEN 0.5 ELSE 0 END::DOUBLE AS score FROM p")
def contradictions(t: Tables) -> DataFrame:
    after = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return t.conversations.join(after, ["conv_id", "turn"]).select("conv_id", "turn", judge.contradiction(F.col("text"), F.col("y")).alias("score"))


def _anchors(x: str) -> str:
    return f"list_filter(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '{extract.WORD}'), lambda w: regexp_matches(w, '{extract.CAPITALISED}')), lambda w: lower(w))), lambda w: w NOT IN ({_NOT_NAMES}))"



@query("merge_safety", "", f"""WITH p AS (SELECT a.conv_id, a.turn, {_anchors('a.text')} AS x, {_anchors('b.text')} AS y, list_distinct({textual.TOK.format(x='a.text')}) AS v, list_distinct({textual.TOK.format(x='b.text')}) AS w FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT *, len(list_intersect(x, y)) AS both_, least(len(x), len(y)) AS least_, CASE WHEN len(v) = 0 AND len(w) = 0 THEN 1 WHEN len(v) = 0 OR len(w) = 0 THEN 0 ELSE len(list_intersect(v, w)) / (len(v) + len(w) - len(list_intersect(v, w))) END AS sim FROM p)
SELECT conv_id, turn, CASE WHEN least_ = 0 OR both_ = least_ THEN false WHEN both_ = 0 THEN true ELSE both_ / least_ <= 0.5 END AS diverging, CASE WHEN len(x) = 0 OR len(y) = 0 THEN sim >= 0.98 WHEN (CASE WHEN least_ = 0 OR both_ = least_ THEN false WHEN both_ = 0 THEN true ELSE both_ / least_ <= 0.5 END) THEN false ELSE sim >= 0.93 END AS safe FROM m""")
def merge_safety(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", judge.anchors(F.col("text")).alias("x"), T.word_set(F.col("text")).alias("v"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"), F.col("v").alias("w"))
    similarity = T.jaccard(F.col("v"), F.col("w"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", judge.diverging(F.col("x"), F.col("y")).alias("diverging"), judge.safe_merge(similarity, F.col("x"), F.col("y")).alias("safe"))


@query("trigrams", "", r"WITH c AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM benchmark), g AS (SELECT item_id, substring(t, i, 3) AS gram FROM (SELECT item_id, t, unnest(range(1, length(t) - 1)) AS i FROM c WHERE length(t) >= 3)), n AS (SELECT item_id, gram, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM n GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(sum(a.n * b.n) / (max(x.s) * max(y.s)), 6)::DOUBLE AS cosine FROM n a JOIN n b ON a.gram = b.gram AND a.item_id < b.item_id JOIN s x ON x.item_id = a.item_id JOIN s y ON y.item_id = b.item_id GROUP BY ALL HAVING sum(a.n * b.n) / (max(x.s) * max(y.s)) > 0.5")
def trigrams(t: Tables) -> DataFrame:
    """Pairs of benchmark items, a bounded table, whose trigrams are alike."""
    c = t.raw("benchmark").select("item_id", T.collapsed(F.col("text")).alias("t")).where("length(t) >= 3")
    n = c.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.lit(3)))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))
    size = n.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("s"))
    own = n.join(size, "item_id")
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, "gram").where("a.item_id < b.item_id").groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg((F.sum(F.col("a.n") * F.col("b.n")) / (F.max("a.s") * F.max("b.s"))).alias("cosine"))
    return pairs.where("cosine > 0.5").withColumn("cosine", F.round("cosine", 6))
