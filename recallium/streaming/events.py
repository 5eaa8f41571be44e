"""Streams of recall events: repeated prompts, running statistics, windows, attribution.

Each function takes and gives streaming DataFrames; :func:`drain` runs one over what its source
holds now and gives the result as a table, which the batch forms of the operators must equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there; the last batch's rows in ``complete`` and ``update``
    mode, all rows in ``append`` mode."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(stream.columns)


def recall_statistics(events: DataFrame) -> DataFrame:
    """Running counts by document; for ``complete`` or ``update`` mode."""
    return events.groupBy("doc_id").agg(F.count("*").alias("recalls"), F.count_if("was_referenced").alias("referenced"), F.round(F.max("search_score"), 6).alias("best_score"))


def windowed_counts(events: DataFrame, late: str = "40 days", width: str = "1 day") -> DataFrame:
    """Events by kind and time window; those later than the watermark don't count."""
    return events.withWatermark("surfaced_at", late).groupBy(F.window("surfaced_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n")


def repeated_prompts(events: DataFrame, seconds: int = 600) -> DataFrame:
    """(id, duplicate): whether an event's (event_type, doc_id) was seen less than so many seconds
    before. Every sighting counts, so the window slides; the state of a key is its last sighting
    and goes when event time has passed it by."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        last = state.get[0] if state.exists else None
        flags = []
        for us in rows["us"]:
            flags.append(last is not None and us - last < seconds * 1_000_000)
            last = us if last is None else max(us, last)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "duplicate": flags})

    timed = events.withWatermark("surfaced_at", "40 days").withColumn("us", F.unix_micros(F.col("surfaced_at").cast("timestamp")))
    return timed.groupBy("event_type", "doc_id").applyInPandasWithState(step, "id long, duplicate boolean", "last long", "append", "EventTimeTimeout")


def attribution(surfaced: DataFrame, used: DataFrame, within: str = "1 day") -> DataFrame:
    """Surfaced events joined with later uses of the same document and session."""
    a = surfaced.withWatermark("surfaced_at", "40 days").select(F.col("id").alias("surfaced_id"), "doc_id", "session_id", F.col("surfaced_at").alias("at"))
    b = used.withWatermark("surfaced_at", "40 days").select(F.col("id").alias("used_id"), F.col("doc_id").alias("d"), F.col("session_id").alias("s"), F.col("surfaced_at").alias("used_at"))
    return a.join(b, F.expr(f"doc_id = d AND session_id = s AND used_at >= at AND used_at <= at + INTERVAL {within}")).select("surfaced_id", "used_id")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of recall events."""
    from ..sources.tables import Tables

    table = Tables(spark, folder)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")  # a pattern: it may be a file or a folder
    table.raw = lambda name: raw  # type: ignore[method-assign]
    return table.recall_events.withColumn("surfaced_at", F.col("surfaced_at").cast("timestamp"))
