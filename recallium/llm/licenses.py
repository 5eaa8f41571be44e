"""Operator 9: licence scans with a generalised suffix automaton of licence tokens.

All templates go into one suffix automaton over words. A document's words are streamed through
it: where the automaton can't go on, it falls back along suffix links, which yields for every word
the longest run ending there that some template contains (matching statistics), and, along the links
from there, where in each template the longest run ends that this one contains. Words of no
template reset it, so only runs of known words are walked. Of these, runs of ``LEAST_RUN`` words and
more that neither the word before nor the next prolongs are kept by template and chained:
a chain's runs go forward in text and template, no gap in the text is longer than the template, and where
two runs overlap in either the second one counts from the overlap's end. The chain that covers most
words is the first span, then the best of the runs that are left, and so on. A chain that covers
``LEAST_COVER`` of its template's words, or that holds ``LONG_RUN`` words in one run, gives the
template's label, unless the chain of another label holds its place and covers more words, or as many and more of its
template (licences share sentences: the one that explains most is meant).

Separately, the places where given phrases stand are counted over the whole text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Defined cases: null and
empty texts have no words, counts 0, null places, empty labels and score 0; phrases may overlap
and every place counts; labels are distinct, sorted and joined by commas; extra columns are never
looked at; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of
from .licence_texts import TEMPLATES

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
LEAST_RUN, LONG_RUN, LEAST_COVER = 3, 12, 0.6
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """The generalised suffix automaton of the templates' words.

    ``ends[state]`` holds the (template, position) at which the state's strings end.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.templates = [words_of(text.encode()) for _, text in templates]
        self.known = {w for t in self.templates for w in t}
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        last_states: list[list[int]] = []
        for words in self.templates:
            last, states = 0, []
            for w in words:
                last = self._extend(last, w)
                states.append(last)
            last_states.append(states)
        ends: list[set] = [set() for _ in self.next]
        for t, states in enumerate(last_states):
            for i, s in enumerate(states):
                while s > 0:
                    ends[s].add((t, i))
                    s = self.link[s]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of each word at which a run of ``LEAST_RUN`` words or more ends:
        the longest that some template contains."""
        known, nxt, link, length = self.known, self.next, self.link, self.length
        state = size = 0
        for i, w in enumerate(words):
            if w not in known:
                state = size = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            if size >= LEAST_RUN:
                yield i, size, state

    def runs(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """By template, (start in the text, start in the template, length) of its longest runs of
        ``LEAST_RUN`` words and more, in the order of their ends."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        templates, link, length = self.templates, self.link, self.length
        for i, size, state in self.statistics(words):
            after, taken = words[i + 1] if i + 1 < len(words) else None, set()
            while size >= LEAST_RUN:
                for t, end in self.ends[state]:
                    if (t, end) not in taken:
                        taken.add((t, end))
                        own = templates[t]
                        if end + 1 == len(own) or own[end + 1] != after:
                            found.setdefault(t, []).append((i - size + 1, end - size + 1, size))
                state = link[state]
                size = length[state]
        return found

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of matched templates."""
        found = []
        for t, parts in self.runs(words).items():
            total = len(self.templates[t])
            for chain, covered in chains(parts, total):
                if covered >= LEAST_COVER * total or max(p[2] for p in chain) >= LONG_RUN:
                    found.append((self.labels[t], chain[0][0], max(p[0] + p[2] for p in chain) - 1, covered, covered / total))
        found.sort(key=lambda f: (f[1], -f[2], -f[3], -f[4]))
        kept, around = [], []
        for label, first, last, covered, share in found:
            around = [f for f in around if f[2] >= first]
            if not any(f[0] != label and f[2] >= last and f[3:] > (covered, share) for f in around):
                kept.append((label, first, last, share))
            around.append((label, first, last, covered, share))
        return sorted(set(kept))


def chains(runs: list[tuple[int, int, int]], total: int) -> Iterator[tuple[list[tuple[int, int, int]], int]]:
    """The chains of a template's runs, each run in one chain, and the words that each covers.

    ``best[j]`` is the most that a chain ending with run j covers. Only runs that end at most
    ``total`` words before run j begins can come before it, so the work is bounded by the runs that lie
    about as near to each other as the template is long.
    """
    runs = sorted(set(runs), key=lambda r: (r[0] + r[2], r[1] + r[2], r[2]))
    best, back = [], []
    low = 0
    for j, (start, at, size) in enumerate(runs):
        while runs[low][0] + runs[low][2] + 2 * total < start + size:
            low += 1
        most, before = size, -1
        for i in range(low, j):
            more = size - max(0, runs[i][0] + runs[i][2] - start, runs[i][1] + runs[i][2] - at)
            if runs[i][0] < start and runs[i][1] < at and runs[i][0] + runs[i][2] + total >= start and more > 0 and best[i] + more > most:
                most, before = best[i] + more, i
        best.append(most)
        back.append(before)
    used = [False] * len(runs)
    for j in sorted(range(len(runs)), key=lambda j: (-best[j], j)):
        chain, k = [], j
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = back[k]
        if chain:
            yield [runs[i] for i in reversed(chain)], best[j] - (best[k] if k >= 0 else 0)


@lru_cache(maxsize=1)
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(list(templates))


def phrase_places(words: list[bytes], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> list[tuple[int, str]]:
    """(start, label) of each place of each phrase."""
    found = []
    for first in phrases.keys() & set(words):
        for phrase, label in phrases[first]:
            at = -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    found.append((at, label))
    return sorted(found)


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: ``key``, n_words, places array<struct<start, label>> of phrases, and spans
    array<struct<label, first, last, cover>> of templates. One narrow pass."""
    by_first: dict[bytes, list] = {}
    for phrase, label in phrases.items():
        own = words_of(phrase.encode())
        by_first.setdefault(own[0], []).append((own, label))
    fixed = tuple(templates)
    out = T.StructType([df.select(key).schema[0], *T._parse_datatype_string("n_words long, places array<struct<start long, label string>>, spans array<struct<label string, first long, last long, cover double>>").fields])
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(fixed)
        for batch in batches:
            for part in slices(batch, "text"):
                n, places, spans = [], [], []
                for value in texts_of(part.column("text")):
                    words = words_of(value)
                    n.append(len(words))
                    places.append([{"start": s, "label": x} for s, x in phrase_places(words, by_first)])
                    spans.append([dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in known.spans(words)])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, type=pa.int64()), pa.array(places, type=place), pa.array(spans, type=span)], names=[key, "n_words", "places", "spans"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
