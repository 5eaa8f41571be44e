"""Tables that grow by segments: what changes are kept as, so that nothing is overwritten.

A batch of changed documents is written as a segment of two tables: ``heads`` (one row a document: its version,
whether it is alive, and what else is known of it) and ``rows`` (all that belongs to it). The head of the greatest
version holds, rows of lesser versions are dead, and a removal is a head that isn't alive.

A segment covers a range of versions and counts once its heads are complete, as these are written last. Merging
writes what lives of neighbouring segments as one that covers all their versions; readers leave out a segment
whose range lies within another's, so the switch happens at once, and a merge or a batch that breaks off, or
is done twice, changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Range = tuple[int, int]


class Segments:
    """The tables in one folder. ``heads`` and ``rows`` are their schemas; both hold doc_id and version."""

    heads: str
    rows: str
    #: The column that rows of a file are sorted by.
    sorted_by: str

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _all(self) -> list[Range]:
        """The ranges of versions of all complete segments."""
        path, system = self._path()
        if not system.exists(path):
            return []
        names = [re.fullmatch(r"(\d+)-(\d+)", s.getPath().getName()) for s in system.listStatus(path)]
        found = [(int(m[1]), int(m[2])) for m in names if m]
        return sorted(s for s in found if system.exists(self._path(f"{s[0]}-{s[1]}/heads/_SUCCESS")[0]))

    def segments(self) -> list[Range]:
        """Those that hold: no other covers them."""
        found = self._all()
        return [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found)]

    def _read(self, what: str, segments: list[Range]) -> DataFrame:
        schema = getattr(self, what)
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{a}-{b}/{what}" for a, b in segments))

    def _write(self, segment: Range, heads: DataFrame, rows: DataFrame) -> None:
        place = f"{self.folder}/{segment[0]}-{segment[1]}"
        rows.sortWithinPartitions(self.sorted_by).write.mode("overwrite").parquet(f"{place}/rows")
        heads.write.mode("overwrite").parquet(f"{place}/heads")

    def next_version(self, version: int | None = None) -> int | None:
        """The version that a batch gets, null if it was applied before. ``version`` is the batch's own
        number where it has one, as in ``foreachBatch``; versions must grow."""
        known = self._all()
        newest = max((b for _, b in known), default=-1)
        if version is None:
            return newest + 1
        if any(a <= version <= b for a, b in known):
            return None
        if version < newest:
            raise ValueError(f"version {version} is older than {newest}")
        return version

    def merge(self, most_rows: int = 10_000_000) -> bool:
        """Put the longest run of neighbouring segments of at most ``most_rows`` rows each together."""
        runs: list[list[Range]] = [[]]
        for s in self.segments():
            if self._read("rows", [s]).count() <= most_rows:
                runs[-1].append(s)
            else:
                runs.append([])
        run = max(runs, key=len)
        if len(run) < 2:
            return False
        self._write((run[0][0], run[-1][1]), self._latest(run), self._live(run))
        for a, b in run:
            path, system = self._path(f"{a}-{b}")
            system.delete(path, True)
        return True

    def _latest(self, segments: list[Range]) -> DataFrame:
        heads = self._read("heads", segments)
        if len(segments) < 2:
            return heads
        rest = [c for c in heads.columns if c not in ("doc_id", "version")]
        last = heads.groupBy("doc_id").agg(F.max_by(F.struct("version", *rest), "version").alias("last"))
        return last.select("doc_id", "last.version", *(f"last.{c}" for c in rest))

    def _live(self, segments: list[Range]) -> DataFrame:
        rows = self._read("rows", segments)
        if len(segments) < 2:
            return rows
        dead = self._read("heads", segments).select("doc_id", "version").join(self._latest(segments).select("doc_id", "version"), ["doc_id", "version"], "left_anti")
        return rows.join(dead, ["doc_id", "version"], "left_anti").select(rows.columns)

    def documents(self) -> DataFrame:
        """The newest head of every document, gone ones too."""
        return self._latest(self.segments())

    def read(self) -> DataFrame:
        """The rows of all documents alive."""
        return self._live(self.segments())
