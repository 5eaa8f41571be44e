"""What transcripts and texts say: topics, actions, questions, paths, facts in XML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of statements, as regular expressions.
DECISIONS = r"(?i)\b(?:we(?:'ll|'ve)?\s+)?decided?\s+(?:to|that|on)\b|\b(?:the\s+)?decision\s+(?:is|was)\s+to\b|\b(?:we(?:'re)?|i(?:'m)?)\s+going\s+(?:to|with)\b|\blet(?:'s)?\s+(?:go\s+with|use|stick\s+with)\b|\bchose\s+(?:to)?\b|\bwe\s+should\s+(?:use|go\s+with|implement)\b|\bthe\s+approach\s+(?:is|will\s+be)\b|\b(?:selected|picking|choosing)\s|\binstead\s+of\b[^\n\r]*\bwe(?:'ll)?\s"
ANTIPATTERNS = r"(?i)\b(?:this\s+)?(?:doesn't|didn't|won't)\s+work\b|\b(?:bug|error|issue|problem|failure)\s+(?:is|was|caused\s+by)\b|\b(?:reverted?|rolled?\s+back|undid|undo)\b|\b(?:wrong\s+approach|bad\s+idea|mistake)\b|\bdon't\s+(?:use|do|try)\b|\b(?:avoid|never|stop)\s+(?:using|doing)\b"
ACTIONS = r"(?i)\b(?:created|wrote|added|implemented|built|set up|configured|installed|fixed|updated|modified|refactored|deleted|removed)\b"
NEXT_STEPS = r"(?i)\bnext\s+(?:step|task|we\s+(?:need|should|can)|up|thing)\b|\btodo\b|\bremaining\b|\blater\b[^\n\r]*\b(?:we|you)\s+(?:can|should|need)\b|\bstill\s+need\s+to\b|\bnot\s+yet\s+(?:done|implemented|completed)\b"
QUESTIONS = [r"(?i)\b(?:should we|do you want|which (?:approach|option)|how should|what about)\b[^.!]*\?", r"(?i)\b(?:TODO|FIXME|HACK|open question|unresolved|needs?\s+(?:investigation|decision))\b[^.!]*"]
#: Where statements end, with what stays of the end.
SENTENCE_END, CLAUSE_END = (r"([.!?])[\t-\r ]+", True), (r"[.!][\t-\r ]+", False)
#: How messages name the files they change; the file is the last group.
CHANGED_FILES = [
    r"(?i)(?:created|wrote|edited|modified|updated|deleted)\s+(?:file\s+)?[`\"]?([^\s`\"]+\.\w{1,10})",
    r"(?i)(?:Write|Edit|Read)\s+tool[^\n\r]*?[`\"]([^\s`\"]+\.\w{1,10})",
    r"(?:^|[\n\r])\s*[-+]{3}\s+[ab]/([^\n\r]+\.\w{1,10})",
]
FILE_PATH = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+"
WORD = r"[\p{L}\p{N}_]+"
PROPER_NOUN = r"^(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[A-Z]{2,}[0-9]*)$"
CAPITALISED = r"^[A-Z][A-Za-z0-9]+$"
#: What divides sentences once their ends are marked; both engines split on it.
MARK = "\u0001"


def sentences(text: Column) -> Column:
    """A text's sentences: they end at . ! or ? before white space, and at line ends."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(text, r"([.!?])[ \t]+", f"$1{MARK}"), "\n", MARK), MARK), lambda s: F.length(F.trim(s)) > 0)


def _newest(turns: DataFrame, last: int | None) -> DataFrame:
    """The last messages of each conversation."""
    if not last:
        return turns
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).drop("_n")


def _once(found: DataFrame, key: Column, limit: int | None, *columns: str) -> DataFrame:
    """Each statement of a conversation where it stands first, the first few of them in order. The
    minimum is combined in each task, so a long conversation is no hot key."""
    first = found.groupBy("conv_id", key.alias("_key")).agg(F.min(F.struct("turn", "place", *columns)).alias("f")).select("conv_id", "f.*")
    if not limit:
        return first
    w = Window.partitionBy("conv_id").orderBy("turn", "place")
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def statements(turns: DataFrame, pattern: str, end: tuple[str, bool] = SENTENCE_END, least: int = 15, most: int = 300, prefix: int = 60, limit: int | None = None, last: int | None = None) -> DataFrame:
    """(conv_id, turn, place, sentence, before): what the assistant says that matches a pattern, each
    once a conversation by its first characters. Turns count messages; null texts say nothing;
    repeated rows count once."""
    mark, keep = end
    parts = F.split(F.regexp_replace(F.col("text"), mark, ("$1" if keep else "") + MARK), MARK)
    said = _newest(turns.select("conv_id", "turn", "role", "text"), last).where("role = 'assistant'").select("conv_id", "turn", parts.alias("s"))
    each = F.posexplode(F.arrays_zip(F.col("s").alias("sentence"), F.concat(F.array(F.lit("")), "s").alias("before"))).alias("place", "p")
    found = said.select("conv_id", "turn", each).select("conv_id", "turn", "place", "p.sentence", "p.before")
    found = found.where(F.length("sentence").between(least, most) & F.col("sentence").rlike(T.ascii_words(pattern)))
    once = _once(found, F.lower(F.substring("sentence", 1, prefix)), limit, "sentence", "before")
    return once.withColumn("sentence", T.stripped(F.col("sentence"))).withColumn("before", T.stripped(F.col("before")))


def decisions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, sentence, context): decisions, with the start of the user's message
    among the three before, if there is one."""
    found = statements(turns, DECISIONS, least=20, most=500, prefix=80).drop("before")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("_asked"), F.substring("text", 1, 200).alias("_text"))
    near = found.withColumn("_back", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("_asked", F.col("turn") - F.col("_back"))
    best = near.join(asked, ["conv_id", "_asked"], "left").groupBy("conv_id", "turn", "place", "sentence").agg(F.max(F.when(F.col("_text").isNotNull(), F.struct("_asked", "_text"))).alias("m"))
    return best.select("conv_id", "turn", "place", "sentence", F.coalesce("m._text", F.lit("")).alias("context"))


def antipatterns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, sentence, context): failures and what to avoid, with the sentence before."""
    return statements(turns, ANTIPATTERNS, CLAUSE_END, 15, 500, 80, 10).withColumnRenamed("before", "context")


def actions(turns: DataFrame) -> DataFrame:
    return statements(turns, ACTIONS, limit=10).drop("before")


def next_steps(turns: DataFrame) -> DataFrame:
    return statements(turns, NEXT_STEPS, limit=5, last=30).drop("before")


def open_questions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, sentence): what anybody leaves open in the last 20 messages."""
    asked = F.concat(*(F.regexp_extract_all("text", F.lit(T.ascii_words(p)), F.lit(0)) for p in QUESTIONS))
    found = _newest(turns.select("conv_id", "turn", "role", "text"), 20).select("conv_id", "turn", F.posexplode(asked).alias("place", "sentence"))
    found = found.withColumn("sentence", T.stripped(F.col("sentence"))).where(F.length("sentence").between(16, 299))
    return _once(found, F.lower(F.substring("sentence", 1, 60)), 10, "sentence")


def changed_files(turns: DataFrame) -> DataFrame:
    """(conv_id, file): the distinct files that an assistant says it changed."""
    named = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in CHANGED_FILES))
    found = turns.where("role = 'assistant'").select("conv_id", F.explode(named).alias("file"))
    return found.where(~F.contains("file", F.lit("*")) & (F.length("file") < 200)).distinct()


def last_requests(turns: DataFrame) -> DataFrame:
    """(conv_id, request): the start of the user's last message of more than 10 characters."""
    asked = turns.where("role = 'user' and length(text) > 10")
    return asked.groupBy("conv_id").agg(F.max(F.struct("turn", F.substring("text", 1, 500).alias("request")))["request"].alias("request"))


def topics(turns: DataFrame, limit: int = 5) -> DataFrame:
    """First lines of users' messages of 10 to 200 characters that are no commands, each once by its
    first 50."""
    line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    t = turns.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("place"), line.alias("topic"))
    t = t.where(F.length("topic").between(10, 200) & ~F.startswith("topic", F.lit("/")))
    return _once(t, F.lower(F.substring("topic", 1, 50)), limit, "topic").drop("place")


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def distinct_words(text: Column, pattern: str) -> Column:
    """The distinct words that match a pattern as a whole."""
    return F.filter(distinct_matches(text, WORD), lambda w: w.rlike(pattern))


def bullets(text: Column) -> Column:
    """Lines that begin with - or * and hold 10 to 200 characters."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*[-*] "))
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s*[-*] ", "")), lambda s: F.length(s).between(10, 200))


def xml_fields(text: Column, fields: list[str]) -> Column:
    """The text of each field's first element, null where there is none."""
    found = [F.regexp_extract(text, f"(?s)<{f}>(.*?)</{f}>", 1) for f in fields]
    return F.struct(*(F.when(x != "", F.trim(x)).alias(f) for f, x in zip(fields, found, strict=True)))


def triples(text: Column) -> Column:
    """The (subject, predicate, object) of <triple> elements."""
    blocks = F.regexp_extract_all(text, F.lit("(?s)<triple>(.*?)</triple>"), F.lit(1))
    return F.transform(blocks, lambda b: xml_fields(b, ["subject", "predicate", "object"]))


def json_block(text: Column) -> Column:
    """The JSON in a model's answer: what a fence holds, else from the first bracket to the last;
    commas before closing brackets go. Null where nothing parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    cut = F.regexp_replace(F.when(fenced != "", F.trim(fenced)).otherwise(bare), r",\s*([\]}])", "$1")
    return F.when(F.try_parse_json(cut).isNotNull() & (cut != ""), cut)
