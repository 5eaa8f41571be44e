"""Operator 10: token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch are put in a trie. Its nodes are visited depth first, and the
forward scores of a unigram model (the best score of a segmentation of the prefix, and its number
of tokens) are computed once a node, so words with a common beginning share that work. A terminal
node stores its word's count; a document's count is the sum over its pre-tokens.

Pieces come from a public vocabulary file. Their scores are log probabilities that :func:`fit` finds for them by
expectation maximisation on all texts: forward and backward sums
run over the same kind of trie, each node and piece once for all words below it, and each round's expected
counts, smoothed by ``SMOOTHING``, are the next round's probabilities. (The file's own scores, which hold without a fit, are ranks of merges and
no probabilities.) For the fit, pre-tokens are cut into runs of ``FITTED`` characters. A segmentation's score is
the sum of its pieces' scores. A character that no piece covers costs ``UNKNOWN_PENALTY`` more than
the dearest piece in use and counts as its UTF-8 bytes, the file's fallback. Of segmentations with equal
scores the one with fewer tokens counts.

Pre-tokens are runs of other characters than white space, each with the vocabulary's word mark
before it. One longer than ``LONGEST`` characters is counted whole, in blocks that carry the last
scores on, and shares nothing with others. Defined cases: null, empty and blank texts have 0
tokens; equal rows get equal counts; extra columns are never looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, release, slices

MARK = "▁"
#: What an unknown character costs beyond the least score, and the score from which on down pieces are disused.
UNKNOWN_PENALTY, DISUSED = 10.0, -1e8
LONGEST = 1000
#: Longer pre-tokens are scored one by one, the others level by level of their trie.
LEVELS = 64
#: Words of one trie.
TRIE_WORDS = 1 << 16
#: Counts kept between batches.
CACHE_ENTRIES = 300_000
#: Of the fit: texts sampled, rounds, what is added to each expected count, and the longest run of characters.
FIT_ROUNDS, SMOOTHING, FITTED = 4, 0.01, 100


class Pieces:
    """The pieces, read from their last character on, as one table of transitions.

    ``of`` gives the number of the piece that ends in a state, or -1; a transition is looked up by state and class of
    a character in a table with open addressing.
    """

    BITS = 19

    def __init__(self, pieces: tuple[str, ...]):
        chars = sorted(set("".join(pieces)))
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n = len(chars) + 1
        known = {c: i + 1 for i, c in enumerate(chars)}
        steps: dict[int, int] = {}
        of = [-1]
        for number, piece in enumerate(pieces):
            state = 0
            for c in reversed(piece):
                key = state * self.n + known[c]
                state = steps.get(key, 0)
                if not state:
                    state = steps[key] = len(of)
                    of.append(-1)
            of[state] = number
        self.of = np.array(of, dtype=np.int32)
        while 4 * len(steps) > 1 << self.BITS:
            self.BITS += 1
        self.keys, self.to = np.full(1 << self.BITS, -1, dtype=np.int64), np.zeros(1 << self.BITS, dtype=np.int32)
        slots = self._slots(np.fromiter(steps, dtype=np.int64, count=len(steps))).tolist()
        for slot, (key, state) in zip(slots, steps.items(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot], self.to[slot] = key, state

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states that follow, 0 where none does."""
        keys = states.astype(np.int64) * self.n + classes
        slots = self._slots(keys)
        out, left = np.zeros(len(keys), dtype=np.int32), np.arange(len(keys))
        while len(left):
            held = self.keys[slots]
            same = held == keys
            out[left[same]] = self.to[slots[same]]
            on = np.flatnonzero(~same & (held >= 0))
            left, keys, slots = left[on], keys[on], (slots[on] + 1) & ((1 << self.BITS) - 1)
        return out


@lru_cache(maxsize=2)
def _pieces(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(pieces)


class Trie:
    """The trie of distinct words in ascending order, its nodes numbered level by level, and the pieces that end in them.

    Node 0 is the root; ``levels[e]:levels[e + 1]`` are the prefixes of e characters. ``edges[size]`` are (begin, end, piece) of all
    pieces of that many characters on paths from the root, in the order of their ends, of which each occurs once.
    """

    def __init__(self, words: list[str], pieces: Pieces, longest: int):
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offset = np.cumsum(size) - size
        shared = np.zeros(len(words), dtype=np.int64)
        same, e = np.arange(1, len(words)), 0
        while len(same):
            same = same[(size[same] > e) & (size[same - 1] > e)]
            same = same[flat[offset[same] + e] == flat[offset[same - 1] + e]]
            e += 1
            shared[same] = e
        self.terminal = np.zeros(len(words), dtype=np.int64)
        self.levels, parents, chars = [0, 1], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.uint32)]
        alive, before = np.arange(len(words)), np.zeros(1, dtype=np.int64)
        for e in range(1, int(size.max(initial=0)) + 1):
            alive = alive[size[alive] >= e]
            made = alive[shared[alive] < e]
            parents.append(self.levels[-2] + np.searchsorted(before, made, side="right") - 1)
            chars.append(flat[offset[made] + e - 1])
            ends = size[made] == e
            self.terminal[made[ends]] = self.levels[-1] + np.flatnonzero(ends)
            self.levels.append(self.levels[-1] + len(made))
            before = made
        self.parent, self.char = np.concatenate(parents), np.concatenate(chars)
        classes = pieces.classes[self.char]
        ends = at = np.arange(1, len(self.parent))
        states = np.zeros(len(ends), dtype=np.int32)
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 3]
        for _ in range(longest):
            states = pieces.step(states, classes[at])
            on = (states > 0).nonzero()[0]
            ends, at, states = ends[on], self.parent[at[on]], states[on]
            piece = pieces.of[states]
            hit = piece >= 0
            self.edges.append((at[hit], ends[hit], piece[hit]))
            on = (at > 0).nonzero()[0]
            ends, at, states = ends[on], at[on], states[on]
        self.cuts = [np.searchsorted(end, self.levels) for _, end, _ in self.edges]

    def ending(self, e: int):
        """(begin, end, piece, size, slice) of the pieces that end on a level, size by size."""
        for size in range(1, min(e, len(self.edges) - 1) + 1):
            low, high = self.cuts[size][e], self.cuts[size][e + 1]
            if low < high:
                begin, end, piece = self.edges[size]
                yield begin[low:high], end[low:high], piece[low:high], size


class Unigrams:
    """The pieces of a vocabulary with their scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = {p: s for p, s in scores.items() if s > DISUSED}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores), default=1)
        #: By last character, the lengths that pieces with it have: others needn't be tried.
        self.lengths: dict[str, list[int]] = {}
        for p in self.scores:
            self.lengths.setdefault(p[-1], []).append(len(p))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.known: dict[str, int] = {}
        self.passing: list[str] = []

    def _extend(self, word: str, best: list[float], count: list[int]) -> None:
        """Carry the scores of a word's prefixes on to its end."""
        scores, lengths, unknown = self.scores, self.lengths, self.unknown
        for end in range(len(best), len(word) + 1):
            c = word[end - 1]
            top, n = best[end - 1] + unknown, count[end - 1] + len(c.encode("utf-8", "replace"))
            for size in lengths.get(c, ()):
                if size > end:
                    break
                s = scores.get(word[end - size : end])
                if s is not None:
                    s += best[end - size]
                    if s > top or s == top and count[end - size] + 1 < n:
                        top, n = s, count[end - size] + 1
            best.append(top)
            count.append(n)

    def count_long(self, word: str) -> int:
        """The count of one word, of whose scores only the last that a piece can reach are held."""
        best, count, start, block = [0.0], [0], 0, LONGEST + self.longest
        while True:
            self._extend(word[start : start + block], best, count)
            if start + block >= len(word):
                return count[-1]
            start += block - self.longest
            best, count = best[-self.longest - 1 :], count[-self.longest - 1 :]

    def count_sorted(self, words: list[str]) -> list[int]:
        """The counts of distinct words in ascending order. A node of their trie takes the best of the pieces that end in it,
        level by level; the scores along the path to the last long word stay for what the next shares."""
        short = [w for w in words if len(w) <= LEVELS]
        counted: dict[str, int] = {}
        for i in range(0, len(short), TRIE_WORDS):
            part = short[i : i + TRIE_WORDS]
            counted.update(zip(part, self._count_levels(part), strict=True))
        best, count = [0.0], [0]
        last = ""
        for word in words if len(short) < len(words) else ():
            if len(word) <= LEVELS:
                continue
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            self._extend(word, best, count)
            counted[word] = count[-1]
            last = word
        return [counted[w] for w in words]

    def _count_levels(self, words: list[str]) -> list[int]:
        trie = Trie(words, _pieces(tuple(self.scores)), self.longest)
        scores = np.fromiter(self.scores.values(), dtype=np.float64, count=len(self.scores))
        char = trie.char
        bytes_of = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        bytes_of[(char >= 0xD800) & (char < 0xE000)] = 1  # replaced
        best, count = np.zeros(len(char)), np.zeros(len(char), dtype=np.int64)
        for e in range(1, len(trie.levels) - 1):
            own = slice(trie.levels[e], trie.levels[e + 1])
            above = trie.parent[own]
            best[own], count[own] = best[above] + self.unknown, count[above] + bytes_of[own]
            for begin, end, piece, _ in trie.ending(e):
                s, n = scores[piece] + best[begin], count[begin] + 1
                held = best[end]
                better = (s > held) | (s == held) & (n < count[end])
                to = end[better]
                best[to], count[to] = s[better], n[better]
        return count[trie.terminal].tolist()

    def count(self, words: set[str]) -> dict[str, int]:
        """The count of each word, kept for later batches unless the word is long."""
        known = self.known
        for w in self.passing:
            known.pop(w, None)
        self.passing = [w for w in words if len(w) > LONGEST]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        fresh = sorted(w for w in words if len(w) <= LONGEST and w not in known)
        known.update((w, self.count_long(w)) for w in self.passing)
        known.update(zip(fresh, self.count_sorted(fresh), strict=True))
        return known


def expected(model: Unigrams, words: list[tuple[str, int]]) -> tuple[dict[str, float], float]:
    """The expected counts of pieces in distinct (word, times), words ascending, over all their
    segmentations, and the words' log likelihood.

    ``forward[i]`` sums the probabilities of all segmentations of a prefix, ``behind[i]`` those of what
    follows it in all words below that node of the trie, each over its word's own sum and times its count. Levels of the trie
    are done one after the other, down for the first and up for the second. Probabilities are scaled by
    a constant a character, which cancels out, to stay within range.
    """
    scale = 12.0
    words = [(w, n) for w, n in words if w]
    if not words:
        return {}, 0.0
    names = tuple(model.scores)
    trie = Trie([w for w, _ in words], _pieces(names), model.longest)
    chance = np.exp(np.fromiter(model.scores.values(), dtype=np.float64, count=len(names))) * scale ** np.fromiter(map(len, names), dtype=np.float64, count=len(names))
    unknown, levels = math.exp(model.unknown) * scale, trie.levels
    forward, behind, found = np.ones(len(trie.char)), np.zeros(len(trie.char)), np.zeros(len(names))
    for e in range(1, len(levels) - 1):
        own = slice(levels[e], levels[e + 1])
        forward[own] = forward[trie.parent[own]] * unknown
        for begin, end, piece, _ in trie.ending(e):
            forward[end] += forward[begin] * chance[piece]
    times = np.array([n for _, n in words], dtype=np.float64)
    last = forward[trie.terminal]
    behind[trie.terminal] += times / last
    likelihood = float((times * (np.log(last) - np.fromiter((len(w) for w, _ in words), dtype=np.float64, count=len(words)) * math.log(scale))).sum())
    for e in range(len(levels) - 2, 0, -1):
        own = slice(levels[e], levels[e + 1])
        up = slice(levels[e - 1], levels[e])
        behind[up] += np.bincount(trie.parent[own] - up.start, weights=unknown * behind[own], minlength=up.stop - up.start)
        for begin, end, piece, size in trie.ending(e):
            g = chance[piece] * behind[end]
            to = slice(levels[e - size], levels[e - size + 1])
            behind[to] += np.bincount(begin - to.start, weights=g, minlength=to.stop - to.start)
            found += np.bincount(piece, weights=forward[begin] * g, minlength=len(names))
    return {names[i]: float(found[i]) for i in np.flatnonzero(found).tolist()}, likelihood


def maximised(model: Unigrams, counted: dict[str, float]) -> dict[str, float]:
    """Scores of the next round."""
    total = sum(counted.values()) + SMOOTHING * len(model.scores)
    return {p: math.log((counted.get(p, 0.0) + SMOOTHING) / total) for p in model.scores}


def fit(df: DataFrame, vocabulary_path: str, *, text: str = "text", rows: int | None = None, rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Log probabilities of the file's pieces, fitted on all texts, or on those ``rows`` that are first by a hash of them."""
    texts = df.select(F.col(text).alias("text")).where("text is not null")
    if rows is not None:
        texts = texts.orderBy(F.xxhash64("text"), "text").limit(rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found: Counter[str] = Counter()
                for t in part.column("text").to_pylist():
                    found.update(t.split())
                words = {MARK + w: n for w, n in found.items() if len(w) < FITTED}
                for w, n in found.items():
                    if len(w) >= FITTED:
                        for i in range(0, len(w) + 1, FITTED):
                            run = (MARK + w)[i : i + FITTED]
                            words[run] = words.get(run, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(words.keys(), type=pa.string()), pa.array(words.values(), type=pa.int64())], names=["word", "n"])
        give_back()

    counted = texts.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted.repartitionByRange(max(8, df.sparkSession.sparkContext.defaultParallelism), "word").sortWithinPartitions("word"), "words")
    pieces = unigrams(vocabulary_path).scores
    scores = dict.fromkeys(pieces, -math.log(max(len(pieces), 1)))
    for _ in range(rounds):
        scores = maximised(Unigrams(scores), {r["piece"]: r["n"] for r in _expected(words, scores).collect()})  # a row a piece
    release(words)
    return scores


def _expected(words: DataFrame, scores: dict[str, float]) -> DataFrame:
    """(piece, n): expected counts of pieces in a table (word, n) that is sorted within its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, own = Unigrams(scores), Counter(), []
        for batch in batches:
            own.extend(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            if len(own) >= TRIE_WORDS:
                found.update(expected(model, sorted(own))[0])
                own = []
        found.update(expected(model, sorted(own))[0])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), type=pa.string()), pa.array(found.values(), type=pa.float64())], names=["piece", "n"])
        give_back()

    return words.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def unigrams(path: str) -> Unigrams:
    """The normal pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigrams({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def pre_tokens(text: str) -> list[str]:
    """The marked pre-tokens of a text."""
    return [MARK + w for w in text.split()]


def count_texts(model: Unigrams, texts: list[str | None]) -> list[int]:
    """The number of tokens of each text."""
    split = [pre_tokens(t) if t else [] for t in texts]
    known = model.count(set().union(*split))
    return [sum(map(known.__getitem__, words)) for words in split]


def counts(df: DataFrame, vocabulary_path: str, scores: dict[str, float] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_pre_tokens long`` and ``n_tokens long`` of every row, in one narrow pass.

    ``scores`` are those of :func:`fit`; without them the file's own hold."""
    out = T.StructType([df.select(key).schema[0], T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigrams(vocabulary_path) if scores is None else Unigrams(scores)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                split = [t.split() if t else [] for t in part.column("text").to_pylist()]
                own = set().union(*split)
                counted = model.count({MARK + w for w in own})
                known = {w: counted[MARK + w] for w in own}
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(map(len, split)), type=pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in split], type=pa.int64())], names=[key, "n_pre_tokens", "n_tokens"])
        model.known.clear()
        give_back()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)


def totals(counted: DataFrame, by: str) -> DataFrame:
    """Documents and tokens by a column, aggregated in each task first."""
    return counted.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
