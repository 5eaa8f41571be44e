"""What a query or text is about, by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A query asks for what is recent if one of these occurs, whatever the case.
RECENT = [
    r"\brecent(ly)?\b",
    r"\blatest\b",
    r"\blast\s+(session|time|week|month|few\s+days)\b",
    r"\bleft\s+off\b",
    r"\bwhere\s+(was|were)\s+(we|i)\b",
    r"\bpick\s+up\b",
    r"\bcontinue\b",
    r"\byesterday\b",
    r"\btoday\b",
    r"\bwhat\s+(was|were)\s+(we|i)\s+(doing|working)\b",
]
#: A query asks for what is stable about a person if one of these occurs.
STABLE = [
    r"\b(pronouns?|timezone|time\s*zone|location|locale|home\s+base)\b",
    r"\b(preferences?|prefers?|identity|profile|bio|about\s+me)\b",
    r"\b(who\s+(am\s+i|is\s+\w+)|what\s+(do\s+i|does\s+\w+)\s+(prefer|use|avoid))\b",
]
#: Paths of documents that describe a person.
PROFILE_PATHS = [r"(^|/)(core/memory|memory/core|profile|identity|soul)\.md$", r"(^|/)users/[^/]+\.md$"]
#: What a model leaves of its template in an expansion.
JUNK = [r"</?think>", r"keyword search terms \(", r"semantic search queries \(", r"hypothetical document passage that answers the query"]
#: An address or a numbered machine is a location.
LOCATIONS = [r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"^VM\s+\d+"]


def any_of(patterns: list[str]) -> str:
    """One pattern for all, whatever the case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def wants_recent(query: Column) -> Column:
    return F.coalesce(query.rlike(any_of(RECENT)), F.lit(False))


def canonical_multiplier(path: Column, kind: Column, query: Column) -> Column:
    """How much more a document that describes a person counts where a query asks for that."""
    asked = query.rlike(any_of(STABLE)) & ~wants_recent(query)
    return F.when(~asked, 1.0).when(path.rlike(any_of(PROFILE_PATHS)), 1.14).when(kind == "preference", 1.08).otherwise(1.0)


def junk(text: Column) -> Column:
    """Blank, or what is left of a template."""
    return F.coalesce((F.trim(text) == "") | text.rlike(any_of(JUNK)), F.lit(True))


def valid_location(name: Column) -> Column:
    return name.rlike(any_of(LOCATIONS))


def query_for_embedding(query: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), query)


def document_for_embedding(text: Column, title: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(title)), r"\s+", " ")


def mentions_document(text: Column, path: Column, title: Column) -> Column:
    """Whether a text names a document: by its path, its file's name of more than three characters
    or its title of at least five."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(md|txt)$", "")
    lower = F.lower(text)
    return F.contains(text, path) | ((F.length(name) > 3) & F.contains(lower, F.lower(name))) | ((F.length(title) >= 5) & F.contains(lower, F.lower(title)))
