"""Scalar functions on text as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import BASELINES

# Words that a query does without if it has others.
STOPWORDS = (
    "a an the how what when where why which who whom whose am is are was were be been being do does did has have had can could will would shall should may might must "
    "to of in on at for with from by about into over under through between during against above below up down out off again further "
    "and or not but if because as until while so than then it its this that these those i me my we us our you your he him his she her they them their "
    "itself himself herself themselves actually really just also very there here all any both each few more most other some such no nor only own same too s t"
).split()

# Words that begin sentences and name nothing.
NOT_NAMES = (
    "the a an this that these those it we i he she they you me him her us them and but or not is was are were be been being have has had "
    "do does did will would should could can may might must shall in on at to for of with by from if then else when while where how why all any some no one two"
).split()


#: White space within ASCII, alike in all engines.
SPACE = r"[\t-\r ]"


def ascii_words(pattern: str) -> str:
    """A pattern whose \\b stands at the ends of ASCII words, which it doesn't in every Java."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """The distinct tokens of a query without stopwords, unless it has only such."""
    every = F.array_distinct(tokens(text))
    kept = F.filter(every, lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def collapsed(text: Column) -> Column:
    """Lower-cased, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def normalized_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.trim(F.lower(text))), 1, 12)


def canonical_id(collection: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", collection, path), 256), 1, 16)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def slug(text: Column) -> Column:
    """Letters and digits joined by hyphens, 50 characters at most."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, 50)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def shingle_set(text: Column) -> Column:
    """Bigrams, and words of more than three characters."""
    t = tokens(text)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(pairs, F.filter(t, lambda w: F.length(w) > 3)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike, one empty one is like nothing."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def csv_escape(text: Column) -> Column:
    """Quoted if it holds a comma, quote or line end."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def numbered_lines(text: Column, first: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + first).cast("string"), F.lit(": "), line)), "\n")


def lines(text: Column, offset: int, limit: int) -> Column:
    """A slice of a text's lines, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), offset, limit), "\n")


def excluded_path(path: Column) -> Column:
    """Whether a part of the path is hidden, private or an excluded folder."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(["node_modules", "dist", "build", ".git", "__pycache__"]) | (p.startswith(".") & (p != ".")) | p.startswith("_"))


def virtual_path(collection: Column, path: Column, scheme: str = "memory") -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), path)


def negated(text: Column) -> Column:
    return F.lower(text).rlike(r"(^|[^a-z])(not|no|never|none|cannot|without|nicht|kein|pas|jamais|nunca)([^a-z]|$)")


def numbers(text: Column) -> Column:
    """The numbers in a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9][0-9,]*(?:[.][0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


#: Signs of a text's worth as regular expressions, and what each adds.
QUALITY_SIGNS = [
    (r"(^|[\n\r])##\s", 0.1),
    (r"(^|[\n\r])[-*]\s", 0.05),
    (r"(?i)\b(decided?\s+to|chose|will\s+use|switching\s+to|going\s+with|selected|adopted)\b", 0.15),
    (r"(?i)\b(fix(ed)?|bug|resolved|corrected|patched|root\s+cause)\b", 0.1),
]


def quality_score(text: Column, tags: Column | None = None, domain: Column | None = None, workstream: Column | None = None) -> Column:
    """0.3, more for length, structure, decisions, corrections and filled metadata, less for stubs;
    0 to 1. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    s = F.lit(0.3) + F.when(n > 200, 0.1).otherwise(0.0) + F.when(n > 500, 0.1).otherwise(0.0)
    for pattern, points in QUALITY_SIGNS:
        s = s + F.when(text.rlike(ascii_words(pattern)), points).otherwise(0.0)
    for filled in ([] if tags is None else [F.size(tags) > 0]) + [F.length(c) > 0 for c in (domain, workstream) if c is not None]:
        s = s + F.when(filled, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s - F.when(n < 50, 0.1).otherwise(0.0)))


#: What in a lower-cased path tells the type of its content, in this order.
PATH_TYPES = [
    ("decision", r"decision|adr/|adr-"),
    ("hub", r"hub|moc|/index\.md$"),
    ("research", r"research|investigation|analysis"),
    ("project", r"project|epic|initiative"),
    ("handoff", r"handoff|handover|session"),
    ("conversation", r"conversation|convo|chat|transcript"),
    ("progress", r"progress|status|standup|changelog"),
]


def content_type(path: Column, explicit: Column | None = None) -> Column:
    """The stated type if it is a known one, else what the path tells; a note without a sign."""
    found = F.lit("note")
    for kind, pattern in reversed(PATH_TYPES):
        found = F.when(F.lower(path).rlike(pattern), kind).otherwise(found)
    return found if explicit is None else F.when(explicit.isin(*BASELINES), explicit).otherwise(found)


_ODD = r"[\x{370}-\x{4FF}]"
_INK = r"[^\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Fixed values: (layer, score, pattern) of attempts to take over an assistant; the first layer that
#: matches counts. The sixth finds words of three characters or more that mix Latin letters with
#: Greek or Cyrillic ones.
INJECTIONS = [
    ("legacy_pattern", 1.0, r"(?i)ignore previous|ignore all previous|ignore above|disregard previous|disregard all previous|you are now|new instructions|system prompt|<system>|</system>|important:|critical:|override"),
    ("role_injection", 0.9, r"(?i)you are (?:now |a |an |the )|act as (?:a |an |the |if )|pretend (?:you(?:'re| are) |to be )|(?:switch|change) (?:to |into )(?:a |an |the )?(?:new |different )?(?:role|mode|persona)|your (?:new |real |true )(?:role|purpose|function|task)"),
    ("instruction_override", 0.85, r"(?i)(?:ignore|forget|discard|disregard) (?:all |any )?(?:previous|prior|above|earlier)|(?:new|updated|revised|real) (?:instructions?|directives?|rules?|guidelines?)|(?:do not|don't|never) (?:follow|obey|listen to|adhere to)|(?:bypass|circumvent|override|skip) (?:the |any |all )?(?:rules?|restrictions?|guidelines?|filters?|safety)"),
    ("delimiter_injection", 0.8, r"(?i)</?(?:system|user|assistant|human|ai|bot|prompt|instruction)>|\[(?:SYSTEM|INST|/INST|SYS)\]|```(?:system|instructions?|prompt)\s*\n|={3,}(?:SYSTEM|PROMPT|INSTRUCTIONS?)={3,}"),
    ("unicode_obfuscation", 0.7, r"[\x{AD}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}]"),
    ("homoglyph", 0.7, rf"[A-Za-z]{_INK}+{_ODD}|{_ODD}{_INK}+[A-Za-z]|{_INK}(?:[A-Za-z]{_ODD}|{_ODD}[A-Za-z])|(?:[A-Za-z]{_ODD}|{_ODD}[A-Za-z]){_INK}"),
]
#: The layer after these, for texts that compatibility decomposition changes much.
DECOMPOSED = ("normalization", 0.7)
#: Characters looked at, and the least score that counts.
INJECTION_HEAD, INJECTION_THRESHOLD = 2000, 0.6
FILTERED = "[content filtered for security]"


def injection(text: Column, threshold: float = INJECTION_THRESHOLD) -> Column:
    """(name, score) of the first layer of patterns that matches in the first 2000 characters; the
    name is null where the score is below the threshold or nothing matches (score 0)."""
    head = F.substring(text, 1, INJECTION_HEAD)

    def layer(name: str | None, score: float) -> Column:
        return F.struct(F.lit(name).cast("string").alias("name"), F.lit(score).alias("score"))

    first = layer(None, 0.0)
    for n, s, pattern in reversed(INJECTIONS):  # one choice of pairs, so that no pattern is tried twice
        first = F.when(head.rlike(pattern), layer(n if s >= threshold else None, s)).otherwise(first)
    return first


#: What stands before the last break of a kind, in the order in which they are tried.
BREAKS = {"paragraph": r"(?s)^(.*)\n\n", "sentence": r"(?s)^(.+[.!?])\s", "line": r"(?s)^(.*)\n", "word": r"(?s)^(.*) "}


def truncated(text: Column, most: int = 300) -> Column:
    """A text cut to some length: after its last paragraph, sentence, line or word that ends in the
    second half, whichever there is first."""
    head = F.substring(text, 1, most)
    kept = {k: F.regexp_extract(head, p, 1) for k, p in BREAKS.items()}
    found = F.concat(_rstripped(head), F.lit("..."))
    for k in reversed(BREAKS):
        whole = kept[k] if k == "sentence" else F.concat(_rstripped(kept[k]), F.lit("..." if k == "word" else ""))
        found = F.when(F.length(kept[k]) > most * 0.5, whole).otherwise(found)
    return F.when(F.length(text) <= most, text).otherwise(found)


def _rstripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


#: Which way of searching a prompt's wording suggests, tried in order.
ROUTES = [
    ("session", r"\b(last session|yesterday|prior session|previous session|last time we|handoff|what happened last|what did we do|cross.session|earlier today|what we discussed|when we last)\b"),
    ("causal", r"\b(why did|why was|why were|what caused|what led to|reason for|decided to|decision about|trade.?off|instead of|chose to)\b|^why\b"),
    ("discovery", r"\b(similar to|related to|what else|what other|reminds? me of|like this)\b"),
]


def route(prompt: Column) -> Column:
    """The way of searching that a prompt's wording suggests, else null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(ROUTES):
        found = F.when(F.lower(prompt).rlike(ascii_words(pattern)), name).otherwise(found)
    return found


#: What tells a prompt that only asks whether somebody is there.
HEARTBEATS = ["heartbeat", "health check", "keepalive", "keep-alive", "status check", "are you alive", "still alive", "ping", "pong"]


def heartbeat(prompt: Column) -> Column:
    """Whether a prompt is empty, a command or a sign of life."""
    p = F.lower(stripped(F.coalesce(prompt, F.lit(""))))
    return (p == "") | F.startswith(p, F.lit("/")) | p.rlike("|".join(HEARTBEATS))


#: The indented output of a tool, and numbered lines of a file.
TOOL_OUTPUT = r"(?i)(?:Result of (?:calling |)(?:the )?(?:Read|Grep|Glob|Bash|Write|Edit|NotebookEdit) tool[^\n]*\n)(?:[ \t]+[^\n]*\n)*"
FILE_DUMP = r"(?m)(?:^ *[0-9]+→[^\n]*\n){5,}"


def pruned(text: Column) -> Column:
    """A message without the output of tools."""
    return F.regexp_replace(F.regexp_replace(text, TOOL_OUTPUT, ""), FILE_DUMP, "[file content pruned]\n")


#: What a prompt's wording says about its intent; each hit counts 3, a leading word 2 more.
INTENTS = {
    "WHY": (r"(?i)\b(why|because|reason|cause|motivation|rationale)\b", r"(?i)^why\b"),
    "WHEN": (r"(?i)\b(when|date|time|yesterday|today|last week|timeline|before|after)\b", r"(?i)^when\b"),
    "ENTITY": (r"(?i)\b(who|whom|person|team|owner|author)\b", r"(?i)^who\b"),
}


def intent(text: Column) -> Column:
    """(intent, confidence); WHAT at 0.6 without a signal, ties to the first."""
    points = {k: F.when(text.rlike(p), 3).otherwise(0) + F.when(text.rlike(lead), 2).otherwise(0) for k, (p, lead) in INTENTS.items()}
    top = F.greatest(*points.values())
    name = F.lit("WHAT")
    for k, p in reversed(points.items()):
        name = F.when((p == top) & (top > 0), k).otherwise(name)
    return F.struct(name.alias("intent"), F.when(top > 0, F.least(F.lit(0.95), 0.6 + 0.1 * top)).otherwise(0.6).alias("confidence"))


#: Patterns that choose a retrieval mode, tried in order.
MODES = [
    ("timeline", r"(?i)last session|yesterday|last week|what happened|timeline"),
    ("causal", r"(?i)^why\b|what caused|led to|because of"),
    ("discovery", r"(?i)similar to|related to|like this"),
    ("complex", r"(?i)\b(compare|versus|vs|and also|as well as)\b"),
    ("keyword", r'^"[^"]+"$|^[A-Za-z0-9_.-]+$'),
    ("semantic", r"(?i)^(how|what|explain|describe)\b"),
]


def retrieval_mode(text: Column) -> Column:
    found = F.lit("hybrid")
    for name, pattern in reversed(MODES):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found
