"""Keeps a stored index up to date from a stream: each micro-batch is one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import IndexStore


def apply(store: IndexStore, batch: DataFrame, id_column: str, deleted: str | None = None, order: str | None = None) -> None:
    """Puts a batch's rows in place of those of the same ids; rows whose column `deleted` is true only take theirs away. Of several rows of one id the last by `order` counts. A batch that comes again changes nothing more."""
    rows = batch.where(F.col(f"`{id_column}`").isNotNull())
    if order is not None:
        last = Window.partitionBy(id_column).orderBy(F.col(order).desc())
        rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    else:
        rows = rows.dropDuplicates([id_column])
    if rows.isEmpty():
        return
    if deleted is None:
        store.update(rows, id_column)
        return
    gone = F.coalesce(F.col(deleted), F.lit(False))
    kept = rows.where(~gone)
    if kept.isEmpty():
        store.delete(rows.select(id_column))
    else:
        store.update(kept, id_column, rows.where(gone).select(id_column))  # both in one version


def maintain(stream: DataFrame, store: IndexStore, id_column: str, checkpoint: str, deleted: str | None = None, order: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that applies each micro-batch of a stream to a stored index."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(store, batch, id_column, deleted, order)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
