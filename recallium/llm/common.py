"""What the operators of this subpackage share: shared folders, batches and stable hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the setting that names the folder shared by driver and executors.
SHARED_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing in local mode, as in tests, a temporary folder is made and the
    session is told about it, so that later calls agree. On a cluster a missing setting is an
    error, as executors would write to disks of their own.
    """
    where = spark.conf.get(SHARED_SETTING, None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{SHARED_SETTING} must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="recallium-shared-")
        spark.conf.set(SHARED_SETTING, where)
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: cuts the lineage
    in a way that survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recallium-{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Up to so many ids are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def if_few(ids: DataFrame) -> DataFrame:
    """A written table of short rows, to be sent to every task if it has few enough of them."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't among ``ids`` (a written table of one column of
    distinct values). Rows don't move unless there are more ids than may be sent to every task."""
    ids = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return df.join(if_few(ids), df[key] == ids["_gone"], "left_anti")


#: Bytes of an Arrow batch between Spark and Python; Spark's own default is 16 times as much.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Rows that a Parquet reader holds at once; by default 4096, which with long texts are large arrays.
READ_SETTING, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 256
#: Bytes of a row group of written tables, which a writer holds in memory; by default 128 MB.
ROW_GROUP_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have this session read texts and send them to Python in small batches, unless it asks for
    smaller ones."""
    for setting, most in ((BATCH_SETTING, BATCH_BYTES), (READ_SETTING, READ_ROWS)):
        now = spark.conf.get(setting, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(setting, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    bound_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text takes about ``most_bytes`` at most (a single
    longer text makes a run of its own), so that memory depends on neither row count nor skew."""
    column = batch.column(text)
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=_offset_type(column.type), count=len(column) + column.offset + 1)[column.offset :]) if len(column) else np.zeros(0)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on from task to task."""
    _POWER_CACHE.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _offset_type(kind: pa.DataType) -> type:
    return np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def keep_rows(df: DataFrame, text: str, wanted: Callable[[list[str | None]], list[bool]], done: Callable[[], None] = lambda: None) -> DataFrame:
    """The rows of ``df`` whose text is wanted, with all their columns: one narrow pass. ``done``
    is called at the end of each task, to let go of what ``wanted`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(wanted(part.column(text).to_pylist()), type=pa.bool_()))
        done()
        give_back()

    return df.mapInArrow(run, df.schema)


_LETTERS_AND_DIGITS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b" \t\n\v\f\r" else c for c in range(256))
_BYTE_VALUES = splitmix(256, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words:
    """The hashed words of many texts at once.

    Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` after A-Z are lower-cased;
    with ``alphanumeric``, of ASCII letters, digits and bytes of other characters.
    ``hashes`` holds one 64-bit hash a word over all texts, ``bounds[i]:bounds[i+1]`` are those
    of text ``i``. Everything is computed on the concatenated bytes without a loop over words.
    """

    def __init__(self, texts: list[bytes], alphanumeric: bool = False):
        joined = np.frombuffer(b" ".join([*texts, b""]).translate(_LETTERS_AND_DIGITS if alphanumeric else _LOWER_WORDS), dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        ends_of_texts = np.cumsum(lengths)
        inside = np.zeros(len(joined) + 2, dtype=np.int8)
        inside[1:-1] = joined != 32
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, ends_of_texts)))
        self.hashes = _hash_runs(joined, self.starts, self.ends)


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2**64 of ``data[starts[i]:ends[i]]`` for every i."""
    with np.errstate(over="ignore"):
        n = len(data)
        powers = _powers(_BASE, n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers, out=total[1:])
        run = total[ends] - total[starts]
        return mix64(run * _powers(_BASE_INVERSE, n)[starts] if n else run)


_POWER_CACHE: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept up to 2 M entries."""
    known = _POWER_CACHE.get(int(base))
    if known is None:
        known = np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while len(known) < n:
            step = np.uint64(pow(int(base), len(known), 1 << 64))
            known = np.concatenate((known, known * step))
    if len(known) <= 2 << 20:
        _POWER_CACHE[int(base)] = known
    return known[:n]


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a text, text by text, and the bounds of
    each text's share. A text of 1 to ``width - 1`` words yields its whole sequence as one."""
    n = np.diff(words.bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    h, total = words.hashes, len(words.hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(total, dtype=np.uint64)
        if total >= width:
            v = h[: total - width + 1].copy()
            for k in range(1, width):
                v *= _BASE
                v += h[k : total - width + 1 + k]
            rolled[: total - width + 1] = mix64(v)
        short = np.flatnonzero((n > 0) & (n < width))
        for i in short.tolist():
            v = np.uint64(n[i])
            for x in h[words.bounds[i] : words.bounds[i + 1]]:
                v = v * _BASE + x
            rolled[words.bounds[i]] = mix64(np.array([v]))[0]
    keep = np.ones(total, dtype=bool)
    for k in range(1, width):  # the last width - 1 words of a text begin no shingle, but the first of a short one
        keep[np.maximum(words.bounds[1:][n >= k] - k, words.bounds[:-1][n >= k] + (n[n >= k] < width))[n[n >= k] - k >= (n[n >= k] < width)]] = False
    return rolled[keep], bounds


def texts_of(column: pa.Array) -> list[bytes]:
    """The values of a text column as UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]
