"""Operator 2: language identification by cross-parsing entropy.

One suffix automaton a language holds labelled text. A document is parsed against each: walk
the automaton as far as the text goes on, then a phrase ends and the next begins at its root (a
byte that a language doesn't know belongs to the phrase it ends).
Phrases times the logarithm of the automaton's text length, by byte parsed, estimate the cross
entropy; the language with the least wins, ties going to the smaller name.

All blocks of ``BLOCK`` bytes of a batch take one step at a time as arrays. Each is first parsed as
if a phrase began with it; then the state in which the parse of the block before ended is walked
through the block beside that until both agree, which takes few bytes, and the difference in
phrases is counted. So phrases run across blocks and the count is that of the whole text.
Work is proportional to the bytes of text; a very long text is only more blocks.

What is learned is bounded: ``DOCUMENTS`` rows a language, the first by a hash in each of as many
classes, those of up to ``SHORT`` bytes before longer ones, taken whole until ``BYTES`` bytes of the
language are there (only the row that passes that is cut). No other language's rows matter.
A worker's tables take about 6 MB a language.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; with no learned
language at all every text does; rows with null key, label or text or held out teach nothing;
rows equal in key, label and text teach once; equal rows get equal results; extra columns are
never looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, if_few, materialize, release, slices

UNKNOWN = "und"
BLOCK = 1024
#: Bounds of what is learned of a language: rows and bytes; rows of up to ``SHORT`` bytes come first.
DOCUMENTS, BYTES, SHORT = 64, 24_000, 2_000
_NO_LETTERS = re.compile(r"[\W\d_]+")


def held_out(key: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text leaves that remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def letters(text: str | None) -> bytes:
    """A text as it is learned and parsed: lower-cased, runs of other characters than letters
    turned into one space. Empty if it has no letter."""
    kept = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if kept and not any(map(str.isalpha, kept)):
        return b""
    return kept.encode("utf-8", "replace")


def learn(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> dict[str, bytes]:
    """Labelled text of each language from a bounded sample of the rows that aren't held out.

    A first pass finds, in each task beforehand, the least hash of each of a language's ``DOCUMENTS``
    classes of hashes; a second takes the texts of these rows alone.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    usable = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    mixed = F.xxhash64("key", "text")
    # One number whose order is that of (longer than SHORT, hash).
    place = F.shiftrightunsigned(mixed, 2).bitwiseOR(F.when(F.octet_length("text") > SHORT, F.lit(1 << 62)).otherwise(F.lit(0)))
    usable = usable.withColumn("place", place).withColumn("class", F.pmod(mixed, F.lit(DOCUMENTS)))
    first = materialize(usable.groupBy("label", "class").agg(F.min("place").alias("place")), "sample")  # DOCUMENTS rows a language
    found = usable.join(if_few(first), ["label", "class", "place"]).dropDuplicates(["label", "class", "place"]).select("label", "place", "text").collect()
    release(first)
    texts: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r["label"], r["place"], r["text"])):
        known = texts.get(r["label"], b"")
        if len(known) < BYTES and (whole := letters(r["text"])):
            texts[r["label"]] = (known + b" " + whole)[:BYTES]
    return texts


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``data``, by state; state 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Parser:
    """All languages' automata as one table of transitions.

    An entry without its sign bit is the next state; the sign bit says that a phrase ended. The
    states of language k lie at ``base[k]``.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        seen = sorted(set(b"".join(texts.values())))
        self.classes = np.zeros(256, dtype=np.int32)  # 0: a byte no language knows
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.pad = len(seen) + 1
        self.width = len(seen) + 2
        automata = [suffix_automaton(texts[x]) for x in self.languages]
        self.base = np.cumsum([0, *(len(a) for a in automata)])[:-1].astype(np.int64)
        self.table = np.zeros((sum(map(len, automata)), self.width), dtype=np.int32)
        for base, moves in zip(self.base.tolist(), automata, strict=True):
            begun = np.full(self.width, base, dtype=np.int32)
            for c, to in moves[0].items():
                begun[self.classes[c]] = base + to
            part = self.table[base : base + len(moves)]
            part[:] = begun - (1 << 30)
            part[:, self.pad] = base
            for state, row in enumerate(moves):
                for c, to in row.items():
                    part[state, self.classes[c]] = base + to
        self.table = self.table.ravel()
        self.bits = np.array([math.log2(max(2, len(texts[x]))) for x in self.languages])

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Estimated bits a byte of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        n = len(owner)
        within = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        filled = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-filled, kind="stable")
        flat = self.classes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        begin = (np.cumsum(sizes) - sizes)[owner] + within * BLOCK
        columns = np.full((BLOCK, n), self.pad, dtype=np.int32)  # by step and place in the order
        for place, k in enumerate(order.tolist()):
            columns[: filled[k], place] = flat[begin[k] : begin[k] + filled[k]]
        phrases = np.zeros((len(self.languages), n), dtype=np.int64)
        state = np.repeat(self.base[:, None], n, axis=1)
        live = np.searchsorted(-filled[order], -np.arange(BLOCK), side="left")  # blocks longer than the step
        for step in range(BLOCK):
            m = int(live[step])
            if not m:
                break
            to = self.table.take(state[:, :m] * self.width + columns[step, :m])
            ended = to < 0
            phrases[:, :m] += ended
            state[:, :m] = to + (ended.astype(np.int32) << 30)
        place_of = np.empty(n, dtype=np.int64)
        place_of[order] = np.arange(n)
        self._carry_on(phrases, state, columns, place_of[np.flatnonzero(within)], place_of[np.flatnonzero(within) - 1], filled[order])
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            counts = np.bincount(owner[order], weights=phrases[k], minlength=len(texts)) + 1
            out[:, k] = counts * self.bits[k] / np.maximum(sizes, 1)
        return out

    def _carry_on(self, phrases: np.ndarray, state: np.ndarray, columns: np.ndarray, blocks: np.ndarray, before: np.ndarray, filled: np.ndarray) -> None:
        """Correct counts and last states of ``blocks``, which were parsed from the root, to what
        they are from the last states of the blocks ``before`` them."""
        begun = np.repeat(self.base[:, None], len(blocks), axis=1)  # the state that each block was last begun with
        while True:
            first = state[:, before]
            language, j = np.nonzero(first != begun)
            if not len(j):
                return
            own, other, at = first[language, j], begun[language, j], blocks[j]
            begun[language, j] = own
            for step in range(BLOCK):
                on = (own != other) & (filled[at] > step)
                if not on.all():
                    done = (own != other) & ~on  # the block is over and they differ: its last state changes
                    state[language[done], at[done]] = own[done]
                    own, other, at, language = own[on], other[on], at[on], language[on]
                if not len(at):
                    break
                cell = columns[step, at]
                a, b = self.table.take(own * self.width + cell), self.table.take(other * self.width + cell)
                np.add.at(phrases, (language, at), (a < 0).astype(np.int64) - (b < 0))
                own, other = a + ((a < 0).astype(np.int32) << 30), b + ((b < 0).astype(np.int32) << 30)
            else:
                done = own != other
                state[language[done], at[done]] = own[done]


@lru_cache(maxsize=1)
def parser(texts: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(texts))


def forget() -> None:
    """Let go of the parser that this process keeps."""
    parser.cache_clear()


def predict(texts: dict[str, bytes], values: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text. The score is the winner's share when each language
    counts 2 to the power of minus 16 times its bits a byte."""
    clean = [letters(v) for v in values]
    at = [i for i, c in enumerate(clean) if c]
    langs, scores = [UNKNOWN] * len(values), [0.0] * len(values)
    if at and texts:
        model = parser(tuple(sorted(texts.items())))
        bits = model.entropies([clean[i] for i in at])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-16 * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
        for i, k, s in zip(at, best.tolist(), share.tolist(), strict=True):
            langs[i], scores[i] = model.languages[k], s
    return langs, scores


def identify(df: DataFrame, learned: dict[str, bytes], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred string`` and ``score double`` for every row, in one narrow pass."""
    out = T.StructType([df.select(key).schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                langs, scores = predict(learned, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[key, "lang_pred", "score"])
        forget()
        give_back()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
