"""Row numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

# ``monotonically_increasing_id`` puts the partition above this bit and counts
# rows from 0 below it.
PARTITION_BIT = 33


def number_rows(df: DataFrame, key: str, order: str, name: str = "rn") -> DataFrame:
    """1-based position of each row within ``key``, by ``order`` of any type and spacing.

    Rows are sorted over all tasks between sampled bounds, so that a key with
    most of the rows spreads over many; the counts of its earlier parts, one row
    per key and part, give each part its offset.
    """
    sorted_rows = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    placed = stash(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", PARTITION_BIT))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = placed.join(stash(parts, "parts"), [key, "_part"])
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return numbered.withColumn(name, position).drop("_at", "_part", "_first", "_before")


def request_slots(
    requests: DataFrame, key: str, order: str, burst: int = 8, per_minute: int = 60
) -> DataFrame:
    """Earliest second and minute batch of each request under a shared budget.

    The first ``burst`` requests of a key may go at once, each later one waits
    for the next of ``per_minute`` tokens.
    """
    numbered = number_rows(requests, key, order, "slot")
    interval = 60.0 / per_minute
    waits = F.greatest(F.col("slot") - F.lit(burst), F.lit(0)) * F.lit(interval)
    return numbered.withColumn("at_second", waits).withColumn("batch", F.floor(F.col("at_second") / 60))
