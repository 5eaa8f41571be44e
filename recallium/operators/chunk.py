"""Cutting texts into fragments: by size with soft breaks, by sections, lists, code and headers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, CHUNK_OVERLAP = 3200, 480
CHUNK_TOKENS, SHARED_TOKENS = 800, 120
LARGE, LARGE_OVERLAP = 2000, 200
MOST_FRAGMENTS = 500


def windows(text: Column, size: int, overlap: int) -> Column:
    """(start, piece) of windows of a size that overlap, from the first character on."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))


def break_before(text: str, low: int, high: int) -> int:
    """Where to end a chunk that may end in (low, high]: after the last paragraph, else sentence,
    else line, else word of that range, else at its end."""
    part = text[low:high]
    for mark in ("\n\n", None, "\n", " "):
        if mark is None:
            ends = [m.end() for m in re.finditer(r"[.!?]\s", part)]
            at = ends[-1] if ends else -1
        else:
            at = part.rfind(mark)
            at = at + len(mark) if at >= 0 else -1
        if at > 0:
            return low + at
    return high


def chunk(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, str]]:
    """(start, chunk): chunks of at most ``size`` characters that end softly in their last 30 %
    and overlap; together they cover the text."""
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            out.append((start, text[start:]))
            break
        end = break_before(text, start + size * 7 // 10, end)
        out.append((start, text[start:end]))
        start = max(end - overlap, start + 1)
    return out


_TOKEN = re.compile(r"\s*[^\W_]{1,8}|\s*[^\w\s]|\s*_|\s+")


def token_ends(text: str) -> np.ndarray:
    """Where tokens end: pieces of words of up to eight letters or digits, and marks, each with the white
    space before it. A model's tokenizer that gives such offsets may take its place."""
    return np.fromiter((m.end() for m in _TOKEN.finditer(text)), dtype=np.int64)


def chunk_by_tokens(text: str, ends: np.ndarray, size: int = CHUNK_TOKENS, overlap: int = SHARED_TOKENS) -> list[tuple[int, int, str]]:
    """(start, tokens, chunk): chunks of at most ``size`` tokens that end softly in their last 30 % and share
    ``overlap`` tokens with the next; together they cover the text. ``ends`` are the ends of its tokens, the
    last one the text's own."""
    if len(ends) <= size:
        return [(0, len(ends), text)]
    out, first = [], 0
    while True:
        start, last = (int(ends[first - 1]) if first else 0), first + size
        if last >= len(ends):
            out.append((start, len(ends) - first, text[start:]))
            return out
        high = int(ends[last - 1])
        end = break_before(text, start + (high - start) * 7 // 10, high)
        whole = int(np.searchsorted(ends, end, side="right"))  # tokens that end there or before
        touched = int(np.searchsorted(ends, end, side="left")) + 1
        out.append((start, touched - first, text[start:end]))
        first = max(whole - overlap, first + 1)


def explode_token_chunks(docs: DataFrame, key: str = "id", text: str = "body", size: int = CHUNK_TOKENS, overlap: int = SHARED_TOKENS) -> DataFrame:
    """(doc_id, seq, start, tokens, chunk) of every document; a null text is an empty one."""

    @F.pandas_udf("array<struct<start: long, tokens: long, chunk: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "tokens": n, "chunk": c} for s, n, c in chunk_by_tokens(t or "", token_ends(t or ""), size, overlap)])

    return docs.select(F.col(key).alias("doc_id"), F.posexplode(cut(F.col(text))).alias("seq", "c")).select("doc_id", "seq", "c.start", "c.tokens", "c.chunk")


def fragments(text: str) -> list[tuple[str, str | None, str]]:
    """(type, label, text): the whole, then sections under headings, lists, code blocks and header
    lines; large ones cut; ``MOST_FRAGMENTS`` at most, the format's limit."""
    out: list[tuple[str, str | None, str]] = [("full", None, text)]
    header = re.match(r"---\n(.*?)\n---\n", text, re.S)
    if header:
        out += [("frontmatter", line.split(":", 1)[0].strip(), line) for line in header[1].split("\n") if ":" in line and len(line) >= 10]
    body = text[header.end() :] if header else text
    heads = [*re.finditer(r"^#{1,3} +(.+)$", body, re.M)]
    for m, after in zip(heads, [*heads[1:], None]):
        section = body[m.start() : after.start() if after else len(body)].strip()
        if len(section) >= 50:
            out.append(("section", m[1].strip(), section))
    for m in re.finditer(r"^```(\w*)\n(.*?)^```", body, re.M | re.S):
        out.append(("code", m[1] or None, m[2]))
    for m in re.finditer(r"(?:^[ \t]*(?:[-*]|\d+\.) .*(?:\n(?:[ \t]+\S.*))*\n?){2,}", body, re.M):
        out.append(("list", None, m[0].rstrip("\n")))
    cut = []
    for kind, label, piece in out:
        if len(piece) > LARGE and kind != "full":
            cut += [(kind, label, piece[i : i + LARGE]) for i in range(0, max(1, len(piece) - LARGE_OVERLAP), LARGE - LARGE_OVERLAP)]
        else:
            cut.append((kind, label, piece))
    return cut[:MOST_FRAGMENTS]


def explode_chunks(docs: DataFrame, key: str = "id", text: str = "body", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, seq, start, chunk) of every document."""

    @F.pandas_udf("array<struct<start: long, chunk: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "chunk": c} for s, c in chunk(t or "", size, overlap)])

    return docs.select(F.col(key).alias("doc_id"), F.posexplode(cut(F.col(text))).alias("seq", "c")).select("doc_id", "seq", "c.start", "c.chunk")


def explode_fragments(docs: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(doc_id, seq, type, label, text) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *f) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, f in enumerate(fragments(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "type", "label", "text"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, seq long, type string, label string, text string")
