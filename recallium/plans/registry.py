"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import admission, extraction, fulltext, guards, maintenance, neighbours, policies, profiles, relational, search, selection, streams, surfaces, textual

MODULES = [relational, textual, search, fulltext, neighbours, guards, policies, extraction, surfaces, maintenance, neighbours, policies, profiles, selection, admission, streams]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: s for m in MODULES for name, s in m.ORACLE.items()}
