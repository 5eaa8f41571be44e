"""Operator 11: whitening by a matrix-free block Lanczos iteration.

The covariance V of the vectors is never formed. A pass over the rows multiplies it with a block of
``BLOCK`` vectors v: each task adds up centred x times (centred x times v) of its rows, and Spark
adds the tasks' sums. The iteration keeps an orthonormal basis Q and its products VQ on the driver
(at most ``BASIS`` vectors of a row's length; no row is ever there):

* a new block is the last product, orthogonalised twice against all of Q;
* on a breakdown, that is where nothing of a column is left, a fixed pseudo-random vector
  orthogonal to all others goes on instead;
* when the basis is full it restarts from the best Ritz vectors and the block after them;
* it ends when the residuals of all wanted pairs, which follow from VQ, are below ``TOLERANCE`` of the
  largest eigenvalue and no larger eigenvalue can be hidden: the basis is complete, or the
  trace that it leaves is below the least wanted eigenvalue, or a further random block orthogonal to
  it changed nothing.

The trace comes from the deviations of the rows and not from eigenvalues, so explained shares are
right however few components are asked for. Components are given a sign by their largest entry.

Vectors are whole numbers x = floor(``SCALE`` * entry) + ``OFFSET``. Sums S over all rows are exact,
and a row is centred as (n * x - S) / n with an exact numerator, so the large offset costs no digits.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry have no row in the
result, neither do those whose length isn't the most frequent one (of equally frequent lengths the
smallest) or zero; rows without an id, or that repeat one, are rows of their own; components whose
eigenvalue is below ``FLAT`` of the largest have no direction of their own and are left out, so
fewer rows than components, equal rows, one row or an empty table give fewer or no components (and no
rows if none); ties between eigenvalues leave any orthonormal basis of their space; entries beyond
+-2**40 / 64 count as that; a deviation that doesn't fit a long is null; extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 40
COMPONENTS, BLOCK, BASIS = 32, 16, 256
TOLERANCE, FLAT = 1e-13, 1e-10


def _kept(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """The usable rows (id, v) and the length of their vectors."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return (rows.where(F.size("v") == size["size"]), size["size"]) if size else (rows, 0)


def whole_numbers(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers x."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in Python's numbers where a long may not hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if most < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def squares(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null where it doesn't fit a long."""
    if y.dtype != object and (np.abs(y).max(initial=0).astype(np.float64) ** 2) * max(y.shape[1], 1) < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [s if (s := sum(v * v for v in row)) < 1 << 63 else None for row in y.tolist()]


def _added(rows: DataFrame, work: Callable[[pa.Array], np.ndarray], kind: str = "double", per_batch: bool = False) -> list:
    """The sum over all rows of what ``work`` makes of a batch: arrays of one fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = work(batch.column("v"))
            total = part if total is None or per_batch else total + part
            if per_batch:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["parts"])
        if total is not None and not per_batch:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["parts"])
        give_back()

    added = rows.select("v").mapInArrow(run, f"parts array<{kind}>").select(F.posexplode("parts").alias("place", "part"))
    value = F.col("part").cast("decimal(20,0)") if kind == "long" else F.col("part")
    found = sorted(added.groupBy("place").agg(F.sum(value).alias("total")).collect())  # as many numbers as a part has
    return [r["total"] for r in found]


def _directions(count: int, size: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((size, count))


def _orthonormal(block: np.ndarray, basis: np.ndarray, seed: int, fill: bool = True) -> np.ndarray:
    """Orthonormal columns that span the block without the basis. A column of which nothing is left
    is replaced by another direction as long as there is one."""
    size, columns = len(block), []
    most = size - basis.shape[1]
    fresh = _directions(block.shape[1], size, seed)
    for k in range(block.shape[1]):
        for v in (block[:, k], fresh[:, k]) if fill else (block[:, k],):
            if len(columns) == most:
                return np.column_stack(columns) if columns else np.zeros((size, 0))
            length = np.linalg.norm(v)
            if not length:
                continue
            w = v / length
            for _ in range(2):
                w = w - basis @ (basis.T @ w)
                for c in columns:
                    w = w - c * (c @ w)
            left = np.linalg.norm(w)
            if left > 1e-10:
                w /= left
                w = w - basis @ (basis.T @ w)
                columns.append(w / np.linalg.norm(w))
                break
    return np.column_stack(columns) if columns else np.zeros((size, 0))


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], size: int, trace: float, wanted: int, *, block: int = BLOCK, most: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator and their vectors."""
    wanted = min(wanted, size)
    most = max(most, wanted + 2 * block)
    q, products = np.zeros((size, 0)), np.zeros((size, 0))
    new, seed, checked = _orthonormal(_directions(block, size, 0), q, 1), 1, None
    while True:
        q, products = np.hstack([q, new]), np.hstack([products, multiply(new)])
        t = q.T @ products
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if q.shape[1] >= wanted:
            best = turn[:, :wanted]
            residuals = np.linalg.norm(products @ best - (q @ best) * values[:wanted], axis=0)
            if q.shape[1] == size:
                return values[:wanted], q @ best
            if (residuals <= TOLERANCE * max(values[0], 0)).all():
                hidden = trace - np.trace(t)
                same = checked is not None and np.allclose(checked, values[:wanted], rtol=1e-12, atol=1e-14 * max(values[0], 0))
                if hidden <= values[wanted - 1] or same:
                    return values[:wanted], q @ best
                checked = values[:wanted]
                seed += 1
                new = _orthonormal(_directions(block, size, seed), q, seed + 1000)
                continue
        checked = None
        if q.shape[1] + block > most:  # restart: the best Ritz vectors, then the block that was to come
            keep = turn[:, : wanted + block]
            following = _orthonormal(products[:, -new.shape[1] :], q, seed)
            q, products = q @ keep, products @ keep
            new = _orthonormal(following, q, seed + 1)
        else:
            new = _orthonormal(products[:, -new.shape[1] :], q, seed)
        seed += 2


def whiten(df: DataFrame, components: int = COMPONENTS, *, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error of every row kept and
    every component, numbered from 1."""
    spark = df.sparkSession
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, size = _kept(df, key, vector)
    if not size:
        return spark.createDataFrame([], schema)

    def counted(column: pa.Array) -> np.ndarray:
        x = whole_numbers(column, size)
        return np.concatenate(([len(x)], x.sum(axis=0)))

    n, *sums = map(int, _added(rows, counted, "long", per_batch=True))

    def centred(column: pa.Array) -> np.ndarray:
        return deviations(whole_numbers(column, size), n, sums).astype(np.float64) / n

    trace = _added(rows, lambda column: np.array([(centred(column) ** 2).sum()]))[0] / n

    def multiply(v: np.ndarray) -> np.ndarray:
        def work(column: pa.Array) -> np.ndarray:
            y = centred(column)
            return (y.T @ (y @ v)).ravel()

        return np.array(_added(rows, work)).reshape(size, -1) / n

    if not trace:
        return spark.createDataFrame([], schema)
    values, vectors = lanczos(multiply, size, trace, components, block=block)
    there = values > FLAT * values[0]
    values, vectors = values[there], vectors[:, there]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    scaled = vectors / np.sqrt(values)

    def moments(column: pa.Array) -> np.ndarray:
        w = centred(column) @ scaled
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    found = np.array(_added(rows, moments)) / n
    mean, second = found[: len(values)], found[len(values) :].reshape(len(values), -1)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = deviations(whole_numbers(batch.column("v"), size), n, sums)
            whitened = (y.astype(np.float64) / n) @ scaled
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(values)), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(squares(y), type=pa.int64()), flat], names=["id", "deviation", "whitened"])
        give_back()

    done = rows.mapInArrow(run, "id long, deviation long, whitened array<double>").select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in values / trace))
    return done.select(
        F.col("id").alias(key),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
