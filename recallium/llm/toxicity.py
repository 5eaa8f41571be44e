"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A window of
``WINDOW_WORDS`` words, which the next overlaps by half, is compressed with the ordinary dictionary and with the toxic one put
before it; how many bytes the toxic one saves is the window's distance. Thresholds on it are
calibrated as log likelihood ratios: how often windows of toxic and of ordinary documents save
0, 1, 2 ... bytes. A document's ratios, summed over all its windows, go through a logistic curve
fitted on documents; a score of 0.5 is the decision.

A toxic dictionary trained on toxic windows as they are is mostly ordinary text, and one trained
on what most of them share loses the words of languages with few toxic documents. So words are
chosen by markers: runs of ``GRAMS`` bytes whose share of toxic windows is ``LIFT`` times that of
ordinary ones, in ``MARKED_DOCUMENTS`` toxic documents at least. How many documents a language has
doesn't matter to that. The toxic dictionary holds the words with markers, the most frequent last; the
ordinary one is trained on windows without markers, and windows without markers in which the
toxic one still saves bytes are added to it in rounds over two halves of the sample. A third part
of the sample serves calibration only. The sample is bounded by rows, whose texts are taken whole:
``TOXIC_DOCUMENTS`` and ``ORDINARY_DOCUMENTS`` labelled ones, the first by a hash of their key, of
texts of up to ``LONGEST_SAMPLED`` bytes. Scoring covers every window of every text.

Defined cases: a text that is null or has no word has no window and gets the score of no
evidence; rows with null key, label or text or that are held out teach nothing; of rows that
repeat a key the greatest label holds and the least text teaches; if either class is missing,
all scores are 0; extra columns are never looked at; equal rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices
from .langid import held_out

WINDOW_WORDS = 8
TOXIC_DOCUMENTS, ORDINARY_DOCUMENTS, LONGEST_SAMPLED = 2500, 5000, 1 << 17
ORDINARY_BYTES, ORDINARY_MOST, TOXIC_BYTES, ROUNDS = 60_000, 120_000, 7_500, 2
#: Lengths of markers in bytes, how much more frequent they are in toxic windows, and in how many toxic documents.
GRAMS, LIFT, MARKED_DOCUMENTS, BUCKET_BITS = (5, 7), 6, 5, 23
#: Of the sampled windows, how many of an ordinary document train its dictionary, and how many join it as hard in a round.
ORDINARY_WINDOWS, HARD_WINDOWS = 60, 1000
#: Saved bytes are counted from LEAST to MOST.
LEAST, MOST = -3, 10
_WORD = re.compile(r"[^\W_]+")
#: The chain covers both dictionaries, and the search is deep enough to reach the toxic one, which lies first.
_PARAMETERS = {"window_log": 17, "chain_log": 17, "hash_log": 17, "search_log": 8, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


class Model(NamedTuple):
    """Both dictionaries, the ratio of each number of saved bytes, the curve's slope and offset."""

    ordinary: bytes
    toxic: bytes
    ratios: tuple[float, ...]
    slope: float
    offset: float


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW_WORDS`` lower-cased words that cover the text and overlap by half."""
    words, half = _WORD.findall((text or "").lower()), WINDOW_WORDS // 2
    starts = range(0, max(len(words) - half, 1), half) if words else ()
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode("utf-8", "replace") for i in starts]


class Meter:
    """Compressors for a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(compression_params=parameters, dict_data=known)

        self._ordinary, self._toxic = compressor(ordinary).compress, compressor(toxic + ordinary).compress

    def saved(self, pieces: list[bytes]) -> np.ndarray:
        """How many bytes fewer each window takes with the toxic dictionary."""
        a, b = self._ordinary, self._toxic
        return np.array([len(a(w)) - len(b(w)) for w in pieces], dtype=np.int64)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many windows save LEAST or less, ..., MOST or more bytes."""
        return np.bincount(np.clip(self.saved(pieces), LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1)


def _spread(items: list, most: int) -> list:
    """At most ``most`` of the items, evenly spread."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a trained dictionary; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size + 1024, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _grams(pieces: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, buckets) of all runs of bytes in windows joined by line ends."""
    data, out = np.frombuffer(b"\n".join(pieces), dtype=np.uint8), []
    for size in GRAMS:
        n = max(len(data) - size + 1, 0)
        run, across = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
        for i in range(size):
            run = (run << np.uint64(8)) | data[i : i + n].astype(np.uint64)
            across |= data[i : i + n] == 10
        spread = (run[~across] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        out.append((size, np.flatnonzero(~across), spread.astype(np.int64)))
    return out


def _frequencies(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """In how many places and documents each bucket's runs are, and how many windows there are.
    A window that several documents share counts once."""
    places, holders = np.zeros(1 << BUCKET_BITS, dtype=np.int32), np.zeros(1 << BUCKET_BITS, dtype=np.int16)
    marks = [np.fromiter(map(hash, d.split(b"\n")), dtype=np.int64) for d in docs]
    new = np.zeros(sum(map(len, marks)), dtype=bool)
    new[np.unique(np.concatenate(marks or [np.zeros(0, dtype=np.int64)]), return_index=True)[1]] = True
    at = 0
    for d, own in zip(docs, marks, strict=True):
        fresh = [w for w, n in zip(d.split(b"\n"), new[at : at + len(own)].tolist(), strict=True) if n]
        at += len(own)
        found, times = np.unique(np.concatenate([buckets for _, _, buckets in _grams(fresh)]), return_counts=True)
        places[found] += times.astype(np.int32)
        holders[found] += 1
    return places, holders, int(new.sum())


def _markers(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Which buckets hold markers."""
    bad, holders, n_bad = _frequencies(toxic)
    likely = np.flatnonzero(holders >= MARKED_DOCUMENTS)
    bad, marks = bad[likely], holders >= 0
    del holders
    good, _, n_good = _frequencies(ordinary)
    marks[:] = False
    marks[likely[bad / max(n_bad, 1) > LIFT * (good[likely] + 2) / max(n_good, 1)]] = True
    return marks


def _split(pieces: list[bytes], marks: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The windows without and with markers."""
    parts: tuple[list[bytes], list[bytes]] = ([], [])
    for k in range(0, len(pieces), 1000):
        some = pieces[k : k + 1000]
        ends, has = np.cumsum([len(w) + 1 for w in some]), np.zeros(len(some), dtype=bool)
        for _, places, buckets in _grams(some):
            has[np.searchsorted(ends, places[marks[buckets]], side="right")] = True
        for w, h in zip(some, has.tolist(), strict=True):
            parts[h].append(w)
    return parts


def _marked_words(docs: list[bytes], marks: np.ndarray) -> list[bytes]:
    """The words, or pairs of neighbours, with markers, the most frequent first."""
    counts: Counter[bytes] = Counter()
    for d in docs:
        for w in _split(list(dict.fromkeys(d.split(b"\n"))), marks)[1]:
            for size, places, buckets in _grams([w]):
                for i in places[marks[buckets]].tolist():
                    start, end = max(w.rfind(b" ", 0, i + 1), 0), w.find(b" ", max(i + size - 1, 1))
                    word = w[start : end + 1] if end >= 0 else w[start:]
                    if word.count(b" ") <= 2:
                        counts[word] += 1
    return [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))]


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model | None:
    """A model from toxic and ordinary documents, each its windows, one a line."""
    toxic, ordinary = [d for d in toxic if d], [d for d in ordinary if d]
    if not toxic or not ordinary:
        return None
    learned = [[d for k, d in enumerate(docs) if k % 3 < 2] for docs in (toxic, ordinary)]
    marks = _markers(*learned)
    good = [_split(list(dict.fromkeys(w for d in ordinary[h::3] for w in _spread(d.split(b"\n"), ORDINARY_WINDOWS))), marks)[0] for h in range(2)]
    own = b""
    for word in _marked_words(learned[0], marks):
        if len(own) + len(word) > TOXIC_BYTES:
            break
        own = word + own
    # Without any marker, as with few labels, what toxic windows share has to do.
    own = own or _trained(TOXIC_BYTES, list(dict.fromkeys(w for d in learned[0] for w in d.split(b"\n"))))
    plain = _trained(ORDINARY_BYTES, _spread(good[0], 12_000))
    for k in range(ROUNDS):
        half = good[(k + 1) % 2]
        hard = [w for w, d in zip(half, Meter(plain, own).saved(half).tolist(), strict=True) if d >= 1][:HARD_WINDOWS]
        plain = (b"".join(hard) + plain)[:ORDINARY_MOST]
    meter = Meter(plain, own)
    held = [np.array([meter.counts(d.split(b"\n")) for d in docs[2::3] or docs]) for docs in (toxic, ordinary)]
    totals = [h.sum(axis=0) + 1.0 for h in held]
    ratios = np.log(totals[0] / totals[0].sum()) - np.log(totals[1] / totals[1].sum())
    x = np.concatenate([h @ ratios for h in held])
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    slope, offset = _logistic(x, y)
    return Model(plain, own, tuple(ratios.tolist()), slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a slight penalty."""
    design, w = np.stack([np.clip(x, -30, 30), np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + 1e-3 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return float(max(w[0], 1e-6)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Train on the bounded sample of labelled rows that aren't held out."""
    spark = docs.sparkSession
    usable = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key"), 5, 0)).groupBy("key").agg(F.max("label").alias("label"))
    usable = usable.withColumn("h", F.xxhash64("key"))
    picked = []
    for which, most in ((1, TOXIC_DOCUMENTS), (0, ORDINARY_DOCUMENTS)):
        own = usable.where(F.col("label") == which)
        # Hashes below a limit that about 1.5 times as many rows have as are wanted.
        share = 1.5 * (most + 100) / max(own.count(), 1)
        likely = own if share >= 1 else own.where(F.col("h") < int((2 * share - 1) * (1 << 63)))
        picked += likely.orderBy("h", "key").limit(most).select("key", "label").collect()
    if not picked:
        return None
    chosen = spark.createDataFrame(picked, usable.select("key", "label").schema)  # at most TOXIC_DOCUMENTS + ORDINARY_DOCUMENTS rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST_SAMPLED).join(F.broadcast(chosen), "key")
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("key", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                pieces = [b"\n".join(windows(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(pieces, type=pa.binary())], names=["key", "label", "windows"])
        give_back()

    kinds = dict(rows.dtypes)
    found = rows.select("key", "label", "text").mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, windows binary").toArrow()
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    keys, marks, pieces = found.column("key").to_pylist(), found.column("label").to_pylist(), found.column("windows")
    for k in sorted(range(len(keys)), key=lambda k: keys[k]):
        by_label[int(marks[k])].append(pieces[k].as_py())
    del found, pieces
    model = train(by_label[1], by_label[0])
    by_label.clear()
    give_back()
    return model


@lru_cache(maxsize=1)
def _meter(ordinary: bytes, toxic: bytes) -> Meter:
    return Meter(ordinary, toxic)


def forget() -> None:
    """Let go of the compressors that this process keeps."""
    _meter.cache_clear()


def scores(model: Model | None, texts: list[str | None]) -> list[float]:
    """The score of each text."""
    if model is None:
        return [0.0] * len(texts)
    meter, ratios = _meter(model.ordinary, model.toxic), np.array(model.ratios)
    x = np.array([float(meter.counts(windows(t)) @ ratios) for t in texts])
    return (1 / (1 + np.exp(-(model.slope * np.clip(x, -30, 30) + model.offset)))).tolist()


def score(df: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score double`` of every row, in one narrow pass."""
    out = T.StructType([df.select(key).schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores(model, part.column("text").to_pylist()), type=pa.float64())], names=[key, "score"])
        forget()
        give_back()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
