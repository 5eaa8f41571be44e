"""What a model answered, checked field by field before anything is changed by it.

Answers are parsed as variants, so that a number in quotes isn't a number and a list isn't a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: How a new fact may relate to an old one, and a document to another.
RELATIONS = ["same", "update", "contradiction"]
LINKS = ["semantic", "supporting", "contradicts"]
#: Predicates of triples; objects of the last two are literals.
PREDICATES = ["adopted", "migrated_to", "deployed_to", "runs_on", "replaced", "depends_on", "integrates_with", "uses", "caused_by", "resolved_by", "owned_by", "prefers", "avoids"]
LITERAL_PREDICATES = ["prefers", "avoids"]
#: Phrases of a prompt's template that a model may repeat as if they were its answer.
TEMPLATE = ["individual atomic fact", "atomic fact", "one atomic claim per fact element", "brief descriptive title", "canonical entity name", "clear deductive statement", "premise from obs 1", "premise from obs 3"]
#: Confidence from which a contradiction counts, characters kept of a fact, least characters of a fragment.
LEAST_CONFIDENCE, FACT_CHARS, FRAGMENT_CHARS = 0.5, 300, 50

MARKER = r"(?s)\{\{.*?\}\}|<!--.*?-->|\$\{.*?\}"
INK = r"[\p{L}\p{N}]"


def placeholder(text: Column) -> Column:
    """Whether a text says nothing: null, without a letter or digit, only markers to be filled in, or
    a phrase of the template. Compatibility forms aren't normalised here."""
    low = F.lower(T.stripped(text))
    marked = low.rlike(MARKER) & ~F.regexp_replace(low, MARKER, "").rlike(INK)
    core = F.regexp_replace(F.regexp_replace(low, rf"{T.SPACE}+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.coalesce(~low.rlike(INK) | marked | core.isin(TEMPLATE), F.lit(True))


def _kind(entry: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant")), F.lit(""))


def _string(entry: Column, name: str) -> Column:
    return F.when(_kind(entry, name) == "STRING", F.try_variant_get(entry, f"$.{name}", "string"))


def _number(entry: Column, name: str) -> Column:
    return F.when(_kind(entry, name).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(entry, f"$.{name}", "double"))


def _within(value: Column, low: float, high: float) -> Column:
    return F.coalesce((value >= low) & (value <= high), F.lit(False))


def _index(value: Column, first: int, last: int) -> Column:
    return _within(value, first, last) & (value == F.floor(value))


def listed(raw: Column) -> Column:
    """The entries of an answer, a list or an object whose ``result`` is one; null for any other."""
    answer = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(answer, "$", "array<variant>"), F.try_variant_get(answer, "$.result", "array<variant>"))


def verdict(entry: Column, candidates: int, facts: int) -> Column:
    """What is wrong with a judged pair of an old and a new fact, else ``ok``; the first fault counts."""
    reasoning = _string(entry, "reasoning")
    return (
        F.when(~F.coalesce(_string(entry, "relation").isin(RELATIONS), F.lit(False)), "invalid-relation")
        .when(reasoning.isNull(), "invalid-reasoning")
        .when(placeholder(reasoning), "placeholder-reasoning")
        .when(~_within(_number(entry, "confidence"), 0, 1), "invalid-confidence")
        .when(~(_index(_number(entry, "old_idx"), 0, candidates - 1) & _index(_number(entry, "new_idx"), 0, facts - 1)), "index-out-of-range")
        .otherwise("ok")
    )


def actionable(relation: Column, confidence: Column) -> Column:
    return (relation == "contradiction") & (confidence >= LEAST_CONFIDENCE)


def entries(answers: DataFrame, key: str, raw: str, candidates: int, facts: int) -> DataFrame:
    """The entries of each answer with their verdict; fields of a refused one may be null."""
    e = answers.select(key, F.posexplode(listed(F.col(raw))).alias("position", "e"))
    return e.select(
        key, "position", verdict(F.col("e"), candidates, facts).alias("verdict"), _string(F.col("e"), "relation").alias("relation"), _string(F.col("e"), "reasoning").alias("reasoning"),
        *(_number(F.col("e"), n).alias(n) for n in ("confidence", "old_idx", "new_idx")),
    )


def admitted(judged: DataFrame, key: str) -> DataFrame:
    """One row for each pair of valid entries: how many say the same of it, and how many different
    things are said. A pair is accepted if all its entries agree; order plays no part."""
    pair = [key, "old_idx", "new_idx"]
    said = judged.where("verdict = 'ok'").groupBy(*pair, "relation", "confidence", "reasoning").agg(F.count("*").alias("n"), F.min("position").alias("position"))
    found = said.groupBy(*pair).agg(
        F.count("*").alias("answers"), F.sum("n").alias("entries"), F.min("position").alias("position"), F.min_by(F.struct("relation", "confidence", "reasoning"), "position").alias("entry")
    )
    return found.select(*pair, "position", "entries", "answers", (F.col("answers") == 1).alias("accepted"), "entry.*")


def batches(judged: DataFrame, key: str) -> DataFrame:
    """Per answer, how many pairs are accepted, how many entries are refused or repeat another, and how
    many pairs are answered in several ways."""
    pairs = admitted(judged, key).groupBy(key).agg(
        F.count_if("accepted").alias("accepted"), F.sum(F.when(F.col("accepted"), F.col("entries") - 1).otherwise(0)).alias("duplicates"), F.count_if(~F.col("accepted")).alias("inconsistent")
    )
    refused = judged.groupBy(key).agg(F.count_if(F.col("verdict") != "ok").alias("rejected"))
    return refused.join(pairs, key, "left").na.fill(0, ["accepted", "duplicates", "inconsistent"])


def facts(raw: Column) -> Column:
    """The texts of a list; null unless it is a list of at least one text and none is blank."""
    found = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    good = F.forall(found, lambda v: F.coalesce((F.schema_of_variant(v) == "STRING") & (T.stripped(F.try_variant_get(v, "$", "string")) != ""), F.lit(False)))
    return F.when((F.size(found) > 0) & good, F.transform(found, lambda v: F.try_variant_get(v, "$", "string")))


def links(raw: Column) -> Column:
    """(target_idx, link_type, confidence, reasoning) of an answer's links; null if one of them isn't valid."""
    found = listed(raw)

    def valid(v: Column) -> Column:
        named = F.coalesce(_string(v, "link_type").isin(LINKS), F.lit(False)) & _string(v, "reasoning").isNotNull()
        return named & _index(_number(v, "target_idx"), 1, 2**53) & _within(_number(v, "confidence"), 0, 1)

    shaped = F.transform(found, lambda v: F.struct(_number(v, "target_idx").cast("long").alias("target_idx"), _string(v, "link_type").alias("link_type"), _number(v, "confidence").alias("confidence"), _string(v, "reasoning").alias("reasoning")))
    return F.when(F.forall(found, valid), shaped)


def legacy_witness(metadata: Column, weight: Column) -> Column:
    """(reasoning, source_fact, target_fact, confidence) that an edge's metadata hold; null unless all
    three texts say something and the weight lies within 0 and 1."""
    m = F.try_parse_json(metadata)
    text = {n: _string(m, n) for n in ("reasoning", "source_fact", "target_fact")}
    good = _within(weight, 0, 1)
    for t in text.values():
        good = good & F.coalesce(T.stripped(t) != "", F.lit(False))
    short = {n: F.substring(t, 1, FACT_CHARS) if n != "reasoning" else t for n, t in text.items()}
    return F.when(good, F.struct(*(t.alias(n) for n, t in short.items()), weight.alias("confidence")))


def census(edges: DataFrame, lane: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Causal edges with both ends in a lane (ids) that no witness (source_id, target_id) supports."""
    e = edges.where("relation_type = 'causal'")
    for end in ("source_id", "target_id"):
        e = e.join(lane.select(F.col("id").alias(end)), end, "left_semi")
    return e.join(witnesses, ["source_id", "target_id"], "left_anti")


def observation_fragments(docs: DataFrame, key: str, body: str, told: str, narrative: str) -> DataFrame:
    """A document's body, its facts of at least fifty characters and its narrative if it is as long, as
    fragments (kind, seq, content); facts that are no valid list give none."""
    piece = lambda kind, seq, content: F.struct(F.lit(kind).alias("kind"), seq.cast("int").alias("seq"), content.alias("content"))
    long_facts = F.filter(F.coalesce(F.from_json(told, "array<string>"), F.array().cast("array<string>")), lambda f: F.length(f) >= FRAGMENT_CHARS)
    pieces = F.concat(
        F.array(piece("full", F.lit(0), F.col(body))),
        F.transform(long_facts, lambda f, k: piece("fact", k, f)),
        F.filter(F.array(piece("narrative", F.lit(0), F.col(narrative))), lambda p: F.length(p.content) >= FRAGMENT_CHARS),
    )
    return docs.select(key, F.inline(pieces))
