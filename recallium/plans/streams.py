"""Queries that run as streams over what is there, held against their batch forms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import sql
from ..streaming import events

QUERIES, ORACLE = {}, {}


def query(name: str, body: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = sql("recall", body)
        return f

    return add


@query("stream_recall_stats", "SELECT doc_id, count(*) AS recalls, count(*) FILTER (was_referenced) AS referenced, round(max(search_score), 6) AS best_score FROM recall GROUP BY doc_id")
def stream_recall_stats(spark: SparkSession, folder: str) -> DataFrame:
    return events.drain(events.recall_statistics(events.event_stream(spark, folder)), "complete")


@query("stream_windowed_counts", "SELECT epoch(date_trunc('day', surfaced_at))::BIGINT AS start, event_type, count(*) AS n FROM recall GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return events.drain(events.windowed_counts(events.event_stream(spark, folder)), "complete")


@query("stream_repeated_prompts", "SELECT id, coalesce(epoch_us(surfaced_at) - lag(epoch_us(surfaced_at)) OVER (PARTITION BY event_type, doc_id ORDER BY surfaced_at, id) < 600000000, false) AS duplicate FROM recall")
def stream_repeated_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return events.drain(events.repeated_prompts(events.event_stream(spark, folder)))


@query("stream_attribution", "SELECT a.id AS surfaced_id, b.id AS used_id FROM recall a JOIN recall b ON a.doc_id = b.doc_id AND a.session_id = b.session_id AND b.was_referenced AND NOT a.was_referenced AND b.surfaced_at >= a.surfaced_at AND b.surfaced_at <= a.surfaced_at + INTERVAL 1 DAY")
def stream_attribution(spark: SparkSession, folder: str) -> DataFrame:
    surfaced = events.event_stream(spark, folder).where("not was_referenced")
    used = events.event_stream(spark, folder).where("was_referenced")
    return events.drain(events.attribution(surfaced, used))
