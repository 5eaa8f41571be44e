"""The folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that are sent to every task.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset in local mode, as in tests, a folder
    of its own. On a cluster a missing setting is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="recallium-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of what stored tables hold by their size, number of files and last change."""
    found = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        size, status = system.getContentSummary(path), system.getFileStatus(path)
        newest = max([status.getModificationTime(), *(s.getModificationTime() for s in system.listStatus(path))])
        found.append(f"{name} {size.getLength()} {size.getFileCount()} {newest}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:32]


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Have this session send rows to Python in batches of so many bytes, unless it asks for smaller ones."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(setting, str(most))


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/recallium-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The same rows as a table, sent to every task that joins them if they are no more than ``most``."""
    kept = written(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def few_like(known: DataFrame, df: DataFrame, most: int = FEW) -> DataFrame:
    """Rows that are no more than those of a table, sent to every task if that has no more than ``most``."""
    return F.broadcast(df) if known.count() <= most else df
