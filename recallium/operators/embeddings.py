"""Vectors of documents' fragments: replaced a document at a time, of one model only.

All fragments of a document go or come together, since a batch is a segment (see :mod:`segments`) whose heads
are written last. A batch may be given again, as ``foreachBatch`` does after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import Segments


class ModelMismatch(ValueError):
    """Vectors of different models, or of different lengths, can't be compared."""


def usable(v: Column) -> Column:
    """A vector with components, none of them null or not finite."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


class Embeddings(Segments):
    heads = "doc_id long, version long, alive boolean, model string, size int, fragments long"
    rows = "doc_id long, version long, seq int, v array<double>"
    sorted_by = "doc_id"

    def models(self) -> list[tuple[str, int, int]]:
        """(model, size, documents) of what is alive; more than one of them is a fault."""
        return [tuple(r) for r in self.documents().where("alive").groupBy("model", "size").count().orderBy("model", "size").limit(100).collect()]

    def require(self, model: str, size: int) -> None:
        """Raise unless vectors of this model and length can be compared with all that are held."""
        held = self.models()
        if any((m, s) != (model, size) for m, s, _ in held):
            raise ModelMismatch(f"{model} of {size} components meets {held}")

    def apply(self, changes: DataFrame, model: str, version: int | None = None) -> int | None:
        """Replace the fragments of documents by those of a batch (doc_id, seq, v); its version, null if it was
        applied before.

        A row whose v is null takes its document's fragments away unless the batch has others for it. Of rows that
        repeat a fragment the greatest vector holds. A batch with a vector that has a component which is null or not
        finite, of vectors of several lengths, or of another model than is held, is refused whole.
        """
        version = self.next_version(version)
        if version is None:
            return None
        given = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("int").alias("seq"), F.col("v").cast("array<double>").alias("v")).where("doc_id is not null")
        found = given.where("v is not null").agg(F.count_if(~usable(F.col("v"))).alias("bad"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        if found["bad"] or found["least"] != found["most"]:
            raise ModelMismatch(f"vectors of {found['least']} to {found['most']} components, {found['bad']} of them broken")
        if found["least"] is not None:
            self.require(model, found["least"])
        vectors = given.where("v is not null").groupBy("doc_id", "seq").agg(F.max("v").alias("v"))
        heads = given.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("v").isNotNull(), F.coalesce("seq", F.lit(-1)))).alias("fragments"), F.max(F.size("v")).alias("size"))
        stamp = F.lit(version).cast("long").alias("version")
        alive = F.col("fragments") > 0
        self._write((version, version), heads.select("doc_id", stamp, alive.alias("alive"), F.lit(model).alias("model"), F.when(alive, F.col("size")).alias("size"), "fragments"), vectors.select("doc_id", stamp, "seq", "v"))
        return version

    def clear(self) -> int | None:
        """Take all vectors away, so that those of another model may come."""
        held = self.documents().where("alive").select("doc_id", F.lit(0).alias("seq"), F.lit(None).cast("array<double>").alias("v"))
        return None if held.isEmpty() else self.apply(held, "")

    def missing(self, docs: DataFrame) -> DataFrame:
        """Documents (doc_id) that have no vector."""
        return docs.select("doc_id").join(self.documents().where("alive").select("doc_id"), "doc_id", "left_anti")
