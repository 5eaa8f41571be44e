"""Readers of markdown folders, transcripts, gold sets and issue lists, and writers of results.

Files are listed and read by Spark; what a file means is told by plain functions of its text,
which run in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

Message = dict  # role, content, timestamp


def expand_braces(pattern: str) -> list[str]:
    """``{a,b}`` is expanded only if it is the whole pattern."""
    m = re.fullmatch(r"\{([^{}]*)\}", pattern)
    return [p.strip() for p in m[1].split(",")] if m else [pattern]


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, body, hash, modified_at) of the files under a folder, without excluded ones."""
    frames = [spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", p.rsplit("/", 1)[-1]).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("modified_at")) for p in expand_braces(pattern)]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    found = whole.withColumn("path", F.element_at(F.split("uri", re.escape(base), 2), -1)).dropDuplicates(["path"])
    return found.where(~T.excluded_path(F.col("path"))).select("path", "body", F.sha2("body", 256).alias("hash"), "modified_at")


def reconcile(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """What a scan means for stored (path, hash, active): insert, update, reactivate, deactivate or
    unchanged, by path."""
    s = stored.select("path", F.col("hash").alias("old"), "active")
    both = scanned.select("path", "hash").join(s, "path", "full")
    what = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("hash").isNull(), F.when(F.col("active"), "deactivate").otherwise("unchanged"))
        .when(~F.col("active"), "reactivate")
        .when(F.col("hash") != F.col("old"), "update")
        .otherwise("unchanged")
    )
    return both.select("path", what.alias("action"))


def frontmatter(text: str) -> tuple[dict, str]:
    """(header, body): flat ``key: value`` lines between dashes, lists in brackets or as items; a
    header that isn't of that kind makes the whole text the body."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    found: dict = {}
    key = None
    for line in m[1].splitlines():
        item, pair = re.match(r"\s*-\s+(.*)$", line), re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line)
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if pair:
            key, value = pair[1], pair[2].strip()
            found[key] = [_plain(v) for v in value[1:-1].split(",") if v.strip()] if re.fullmatch(r"\[.*\]", value) else _plain(value)
        elif item and key and found.get(key) in ("", *([found[key]] if isinstance(found.get(key), list) else [])):
            found[key] = [*(found[key] or []), _plain(item[1])]
        else:
            return {}, text
    return found, text[m.end() :]


def _plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _stamp(value) -> str | None:
    """An instant as ISO in UTC: seconds since 1970 or a stamp with an offset."""
    try:
        if isinstance(value, (int, float)) or re.fullmatch(r"\d{10}(\.\d+)?", str(value)):
            return datetime.fromtimestamp(float(value), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", str(value)):
            return datetime.fromisoformat(str(value).replace("Z", "+00:00")).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, OverflowError, OSError):
        pass
    return None


def _content(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(p if isinstance(p, str) else p.get("text", "") for p in value if isinstance(p, (str, dict)))
    return value.get("text", "") or "\n".join(p for p in value.get("parts", []) if isinstance(p, str)) if isinstance(value, dict) else ""


def _message(role, content, stamp=None) -> Message | None:
    role = {"human": "user", "user": "user", "assistant": "assistant", "agent": "assistant", "ai": "assistant"}.get(str(role).lower())
    content = _content(content).strip()
    return {"role": role, "content": content, "timestamp": _stamp(stamp)} if role and content else None


def _json_lines(text: str) -> list[dict]:
    rows = []
    for line in text.splitlines():
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError:
                return []
            if isinstance(row, dict):
                rows.append(row)
    return rows


def agent_lines(text: str) -> list[Message]:
    """JSON lines whose ``type`` is human, user or assistant and whose message has content."""
    return [m for r in _json_lines(text) if r.get("type") in ("human", "user", "assistant") and isinstance(r.get("message"), dict) and (m := _message(r["type"], r["message"].get("content"), r.get("timestamp")))]


def session_lines(text: str) -> list[Message]:
    """JSON lines with a session_meta row, of which event_msg rows are messages."""
    rows = _json_lines(text)
    if not any(r.get("type") == "session_meta" for r in rows):
        return []
    kinds = {"user_message": "user", "agent_message": "assistant"}
    events = [(r, r["payload"]) for r in rows if r.get("type") == "event_msg" and isinstance(r.get("payload"), dict)]
    return [m for r, p in events if p.get("type") in kinds and (m := _message(kinds[p["type"]], p.get("message"), r.get("timestamp")))]


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def chat_export(text: str) -> list[Message]:
    """A conversation or a list of them, with ``messages`` or ``chat_messages``."""
    data = _json(text)
    out = []
    for c in data if isinstance(data, list) else [data]:
        if isinstance(c, dict):
            rows = c.get("messages") or c.get("chat_messages") or []
            out += [m for r in rows if isinstance(r, dict) and (m := _message(r.get("role") or r.get("sender"), r.get("content") or r.get("text") or "", r.get("created_at") or r.get("timestamp")))]
    return out


def mapping_tree(text: str) -> list[Message]:
    """A tree of nodes: from its root along first children."""
    data = _json(text)
    data = data[0] if isinstance(data, list) and data else data
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    roots = [k for k, n in nodes.items() if isinstance(n, dict) and n.get("parent") is None]
    at = next((k for k in roots if not nodes[k].get("message")), roots[0] if roots else None)
    out, seen = [], set()
    while at is not None and at in nodes and at not in seen:
        seen.add(at)
        m = nodes[at].get("message")
        if isinstance(m, dict) and (row := _message((m.get("author") or {}).get("role"), m.get("content") or "", m.get("create_time"))):
            out.append(row)
        at = next(iter(nodes[at].get("children") or []), None)
    return out


def messenger(text: str) -> list[Message]:
    """A list of messages between exactly two people: who is seen first is the user."""
    data = _json(text)
    rows = [r for r in data if isinstance(r, dict) and r.get("type") == "message" and r.get("user")] if isinstance(data, list) else []
    people = list(dict.fromkeys(r["user"] for r in rows))
    if len(people) != 2:
        return []
    return [m for r in rows if (m := _message("user" if r["user"] == people[0] else "assistant", r.get("text") or "", r.get("ts")))]


def prefixed_text(text: str) -> list[Message]:
    """Lines that begin with a role and a colon begin messages; four and both roles are needed."""
    parts = re.split(r"(?im)^(user|human|you|assistant|ai|agent):[ \t]*", text)
    out = [m for role, body in zip(parts[1::2], parts[2::2], strict=False) if (m := _message("user" if role.lower() in ("user", "human", "you") else "assistant", body))]
    return out if len(out) >= 4 and {m["role"] for m in out} == {"user", "assistant"} else []


FORMATS: list[tuple[str, Callable[[str], list[Message]]]] = [("agent_lines", agent_lines), ("session_lines", session_lines), ("chat_export", chat_export), ("mapping_tree", mapping_tree), ("messenger", messenger), ("prefixed_text", prefixed_text)]


def sniff(text: str) -> tuple[str | None, list[Message]]:
    """The first format that finds two messages or more."""
    for name, parse in FORMATS:
        found = parse(text)
        if len(found) >= 2:
            return name, found
    return None, []


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, turn, role, content, timestamp) of the conversations under a folder."""
    files = scan(spark, root, "{*.txt,*.md,*.json,*.jsonl}").select("path", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                name, found = sniff(body or "")
                rows += [(path, name, i, m["role"], m["content"], m["timestamp"]) for i, m in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "format", "turn", "role", "content", "timestamp"])

    return files.mapInPandas(run, "path string, format string, turn long, role string, content string, timestamp string")


GOLD_SCHEMA = "id string, query string, mode string, collection string, include_internal boolean, gold_evidence array<struct<collection: string, path: string, hash: string>>, tags array<string>"


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """A gold set of JSON lines; a malformed line or a repeated id fails the load when it runs."""
    rows = spark.read.schema(GOLD_SCHEMA).option("mode", "FAILFAST").json(path)
    once = F.raise_error(F.concat(F.lit("repeated id "), F.col("id")))
    n = rows.groupBy("id").agg(F.count("*").alias("n"))
    checked = rows.join(n, "id").withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(once)).drop("n")
    return checked.withColumn("tags", F.array_distinct("tags"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    """An issue tracker's JSON lines with aliases of fields resolved and defaults filled."""
    rows = spark.read.schema("id string, title string, name string, description string, body string, status string, state string, priority long, labels array<string>, created_at string, updated_at string, depends_on array<string>").json(path)
    return rows.select("id", F.coalesce("title", "name", F.lit("")).alias("title"), F.coalesce("description", "body", F.lit("")).alias("description"), F.coalesce("status", "state", F.lit("open")).alias("status"), F.coalesce("priority", F.lit(2)).alias("priority"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "created_at", "updated_at", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def write_results(df: DataFrame, path: str, kind: str) -> None:
    """Results as json, csv, xml or parquet files."""
    if kind == "xml":
        df.write.format("xml").option("rowTag", "result").save(path)
    else:
        df.write.format(kind).option("header", "true").save(path)
