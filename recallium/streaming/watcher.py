"""A folder watched as a stream: what was written, changed or removed, once it has come to rest.

:func:`note` writes a listing of the folder as one file of a notes folder, which is the stream's source; a
scheduler calls it as often as changes are to be seen. :func:`changes` keeps a state per path: a file counts as changed
once it has looked the same for ``rest_ms``, by the listings' own times, and as removed once listings have gone on
for so long without it, which an event-time timer tells. :func:`feed` brings such changes into a full-text index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.postings import Postings
from ..sources import readers

NOTE = "path string, stamp string, seen_at timestamp"
#: So many changed files of a batch are read by name; of more, the folder is read and joined.
BY_NAME = 10_000


def _below(uri: Column, base: str) -> Column:
    """The part of a path below a folder."""
    return F.split_part(uri, F.lit(base), F.lit(2))


def note(spark: SparkSession, root: str, notes: str, seen_at: str, pattern: str = "*.md") -> None:
    """Append a listing: one row a file, without excluded ones and without reading any, and one with an empty
    path, so that listings of an empty folder still carry their time on."""
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = listed.select(_below(F.col("path"), base).alias("path"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp"))
    files = files.where((F.col("path") != "") & ~T.excluded_path(F.col("path")))
    rows = files.unionByName(spark.createDataFrame([("", "")], "path string, stamp string"))
    rows.select("path", "stamp", F.lit(seen_at).cast("timestamp").alias("seen_at")).coalesce(1).write.mode("append").parquet(notes)


def listings(spark: SparkSession, notes: str) -> DataFrame:
    """The notes as a stream, a listing a batch."""
    return spark.readStream.schema(NOTE).option("maxFilesPerTrigger", 1).parquet(notes)


def changes(seen: DataFrame, rest_ms: int = 2000) -> DataFrame:
    """(path, event, at): ``changed`` or ``removed`` and the time of the listing that told."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, last, _, told = state.get
            state.remove()
            if told and key[0]:
                yield pd.DataFrame({"path": [key[0]], "event": ["removed"], "at": pd.to_datetime([last + rest_ms], unit="ms")})
            return
        # since: when the file began to look as it does; -1 once that was told.
        stamp, last, since, told = state.get if state.exists else (None, 0, -1, False)
        out = []
        for at, new in pd.concat(list(batches)).sort_values("ms")[["ms", "stamp"]].itertuples(index=False):
            last = int(at)
            if new != stamp:
                stamp, since = new, last
            if since >= 0 and last - since >= rest_ms:
                out.append(last)
                since, told = -1, True
        state.update((stamp, last, since, told))
        state.setTimeoutTimestamp(max(last + rest_ms, state.getCurrentWatermarkMs() + 1))
        if key[0]:
            yield pd.DataFrame({"path": [key[0]] * len(out), "event": ["changed"] * len(out), "at": pd.to_datetime(out, unit="ms")})

    timed = seen.withWatermark("seen_at", "0 seconds").withColumn("ms", F.unix_millis("seen_at"))
    return timed.groupBy("path").applyInPandasWithState(step, "path string, event string, at timestamp", "stamp string, last long, since long, told boolean", "append", "EventTimeTimeout")


def feed(index: Postings, root: str, collection: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` needs to bring changed and removed files into an index."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max_by("event", "at").alias("event"))
        names = [r["path"] for r in last.where("event = 'changed'").limit(BY_NAME + 1).collect()]
        if not names:
            files = spark.createDataFrame([], "path string, body string")
        elif len(names) <= BY_NAME:
            base = root.split("://", 1)[-1].rstrip("/") + "/"
            read = spark.read.option("ignoreMissingFiles", "true").text([f"{root.rstrip('/')}/{n}" for n in names], wholetext=True)
            files = read.select(_below(F.col("_metadata.file_path"), base).alias("path"), F.col("value").alias("body"))
        else:
            files = readers.scan(spark, root).select("path", "body")
        rows = last.join(files, "path", "left")
        title = F.nullif(F.trim(F.regexp_extract("body", r"(?:^|\n)#{1,3} +([^\n]+)", 1)), F.lit(""))
        index.apply(rows.select(F.xxhash64(F.lit(collection), "path").alias("doc_id"), F.concat_ws("/", F.lit(collection), "path").alias("path"), title.alias("title"), "body", F.col("body").isNotNull().alias("alive")), number)

    return apply


def catch_up(spark: SparkSession, notes: str, checkpoint: str, apply: Callable[[DataFrame, int], None], rest_ms: int = 2000) -> None:
    """Run the stream over all listings that are there."""
    query = changes(listings(spark, notes), rest_ms).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
