"""Operator 1: BPE encoding and decoding with a pair occurrence index.

All distinct pre-tokens of a batch are laid out as one linked list of symbols. The index maps
every pair that has a merge rank to all its positions. The ranks present are taken in ascending
order; a rank is applied at all its positions at once, and only the lists of the pairs to the
left and right of those positions change. That is the order in which merging each pre-token by
itself would go, as no merge of this kind of vocabulary enables one of a lower rank; where a
vocabulary has such merges, the lower rank is taken next because ranks wait in a heap.

Defined cases: a null or empty text has no tokens and decodes to the empty string; texts are
encoded whole whatever their length; equal rows give equal results, row by row; extra columns
are carried only on request and never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices

#: Texts of these characters are prepared here; all others by the library's own normaliser.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-ɏ]*")
#: Distinct pre-tokens kept between batches.
CACHE_ENTRIES = 120_000
#: Text whose pre-tokens are merged together.
SLICE_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that
    are printable in Latin-1 stand for themselves, the others take code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file with word-end BPE, read once a Python worker."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = token
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([self.ids[c] for c in byte_symbols()], dtype=np.int64)
        self.final = np.array([self.ids[c + suffix] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.merged = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        # The same pattern with its classes written out for the plain characters: a faster engine takes it.
        for name, initial in (("\\p{L}", "L"), ("\\p{N}", "N")):
            split = split.replace(name, "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == initial))
        self.plain_pattern = re.compile(split)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = tokenizers.Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Drop what is known of pre-tokens, as at the end of a task."""
        self.known: dict[str, int] = {}
        self.flat, self.counts, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Keep the ids of these pre-tokens, ``counts`` of them each."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.offsets = np.concatenate((self.offsets, len(self.flat) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where it has none."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; special tokens appear as themselves."""
        if not self._special or not self._special.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self.plain_pattern.findall(text.lower())
        return self.pattern.findall(self._library.normalizer.normalize_str(text))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(voc: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of the pre-tokens one after another and how many each has, all merged
    together through one pair occurrence index."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
    ends = np.cumsum(sizes)
    last = ends[sizes > 0] - 1
    symbols = voc.inner[data]
    symbols[last] = voc.final[data[last]]
    after = np.arange(1, n + 1)
    after[last] = -1
    before = np.arange(-1, n - 1)
    before[last[:-1] + 1] = -1

    # The index: rank -> arrays of positions at which its pair begins.
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Add the pairs that begin at these positions."""
        at = at[after[at] >= 0]
        rank = voc.ranks(symbols[at], symbols[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        lows = [0, *cuts.tolist()]
        for low, high, r in zip(lows, [*lows[1:], len(at)], rank[lows].tolist(), strict=True):
            if (known := index.get(r)) is None:
                index[r] = [at[low:high]]
                heapq.heappush(waiting, r)
            else:
                known.append(at[low:high])

    marked = np.zeros(n, dtype=bool)
    enter(np.flatnonzero(after >= 0))
    while waiting:
        r = heapq.heappop(waiting)
        lists = index.pop(r)
        at = np.concatenate(lists) if len(lists) > 1 else lists[0]
        a, b = voc.left[r], voc.right[r]
        follow = after[at]
        at = at[(symbols[at] == a) & (follow >= 0) & (symbols[follow] == b)]
        if a == b and len(at) > 1:
            at = _leftmost(np.sort(at), after)
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        symbols[at] = voc.merged[r]
        symbols[gone] = -1
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        left = before[at]
        left = left[left >= 0]
        # Symbols only grow, so a position never gets a pair again that it had: lists hold no
        # position twice if no call of enter does.
        marked[left] = True
        enter(np.concatenate((left, at[~marked[at]])))
        marked[left] = False
    kept = symbols >= 0
    counts = np.diff(np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))])
    return symbols[kept], counts


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in runs of one symbol, those that a scan from the left merges."""
    taken, blocked = [], -1
    for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
        if p != blocked:
            taken.append(p)
            blocked = q
    return np.array(taken, dtype=np.int64)


def encode_texts(voc: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all texts in one array, and where each text's ids begin and end."""
    split = [voc.pre_tokens(t) for t in texts]
    if len(voc.known) > CACHE_ENTRIES:
        voc.forget()
    known = voc.known
    fresh = [w for w in set().union(*split) if w not in known]
    if fresh:
        ordinary = [w for w in fresh if w not in voc.special]
        voc.learn(ordinary, *merge_all(voc, ordinary))
        special = [w for w in fresh if w in voc.special]
        voc.learn(special, np.array([voc.special[w] for w in special], dtype=np.int32), np.ones(len(special), dtype=np.int64))
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64)
    counts = voc.counts[words]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    flat = voc.flat[np.arange(total) + np.repeat(voc.offsets[words] - (ends - counts), counts)]
    of_words = np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)
    return flat, np.concatenate(([0], ends))[of_words]


def decode_ids(voc: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by one space, as the library does for a file without a decoder."""
    return " ".join(map(voc.tokens.__getitem__, ids))


def encode(df: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per input row: ``key``, ``ids array<int>``, ``decoded string``. One narrow
    pass without a shuffle; memory is bounded by a run of about 2 MB of text or one longer text.
    """
    out = T.StructType([df.select(key).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(vocabulary_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                flat, at = encode_texts(voc, [t or "" for t in part.column("text").to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                decoded = pa.array([decode_ids(voc, flat[low:high].tolist()) for low, high in zip(at[:-1], at[1:], strict=True)], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, decoded], names=[key, "ids", "decoded"])
        voc.forget()
        give_back()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
