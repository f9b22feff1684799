"""Consecutive numbers in an order, without bringing all rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names; one of its own only where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage by a checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """A column of the numbers start, start + 1, ... in this order. Rows are partitioned by ranges and sorted there; a number is the place in the partition and what lies before it, for which one count of each partition is sent to the driver."""
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    counts = dict(rows.select(F.shiftright(place, 33).alias("p")).groupBy("p").count().collect())
    before, total = {}, start
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    if not counts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    offsets = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))
    return rows.withColumn("__place", place).withColumn(name, F.element_at(offsets, F.shiftright("__place", 33)) + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place")
