"""Extendible hashing: shards that split on one more hash bit until they fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_table_path, stash
from .common import renamed, seeded, text_of

BITS = 60
#: Bits looked at beyond those an even spread would need, in the first pass and in each later one.
AHEAD = 3
STEP = 8


def _prefix(bits) -> F.Column:
    """The leading ``bits`` of the 60-bit hash, as a number."""
    return F.expr(f"shiftright(_h, {BITS - bits})") if isinstance(bits, int) else F.expr(f"shiftright(_h, {BITS} - {bits})")


def directory(hashed: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directory tables (cell, depth, bucket, shard_bytes, shard_docs), each with the bits of its cells.

    One aggregation by the hash prefix gives the cells; sums over their
    ancestors tell which buckets overflow. A bucket is the first prefix that
    fits, or whose rows all share one hash. Only cells that still overflow are
    looked at again, with more bits.
    """
    total = hashed.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    tables, left, least = [], hashed, 0
    while True:
        cells = left.groupBy(_prefix(bits).alias("_cell")).agg(
            F.sum("_bytes").alias("_bytes"), F.count("*").alias("_n"), F.min("_h").alias("_low"), F.max("_h").alias("_high")
        )
        cells = stash(cells, "cells")
        above = cells.withColumn("_depth", F.explode(F.sequence(F.lit(least), F.lit(bits)))).withColumn(
            "_bucket", F.expr(f"shiftright(_cell, {bits} - _depth)")
        )
        sums = above.groupBy("_depth", "_bucket").agg(
            F.sum("_bytes").alias("shard_bytes"), F.sum("_n").alias("shard_docs"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
        )
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("_low") == F.col("_high")))
        pick = F.min(F.struct("_depth", "_bucket", "shard_bytes", "shard_docs")).alias("p")
        chosen = above.select("_cell", "_depth", "_bucket").join(fits, ["_depth", "_bucket"]).groupBy("_cell").agg(pick)
        chosen = stash(chosen.select("_cell", "p.*"), "directory")
        tables.append((bits, chosen))
        over = cells.join(chosen, "_cell", "left_anti").select("_cell")
        if bits == BITS or over.isEmpty():
            return tables
        left = stash(left.withColumn("_cell", _prefix(bits)).join(over, "_cell", "left_semi").drop("_cell"), "overflow")
        least, bits = bits + 1, min(BITS, bits + STEP)


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", seed: str = "shard") -> DataFrame:
    """``docs`` with n_bytes, shard, depth, shard_bytes and shard_docs.

    ``shard`` is the bucket's hash prefix in binary (empty for a directory of
    one bucket). Rows with equal ids share all hash bits: a bucket of only such
    rows is cut into numbered parts (``prefix-salt-part``), each within the
    limit. A single row over the limit is a shard of its own. Null text counts
    0 bytes, null ids are one id. Columns of ``docs`` with those names are
    replaced; an empty table gives no rows.
    """
    docs, names = renamed(docs)
    rows = docs.withColumn("n_bytes", F.octet_length(text_of(names[text_col])).cast("long")).withColumn("_h", seeded(names[id_col], seed))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    hashed = stash(rows.select("_h", F.col("n_bytes").alias("_bytes")), "hashes")
    found = None
    for bits, part in directory(hashed, limit):
        entry = part.withColumnRenamed("_cell", f"_cell{bits}").select(
            f"_cell{bits}", F.struct("_depth", "_bucket", "shard_bytes", "shard_docs").alias(f"_e{bits}")
        )
        rows = rows.withColumn(f"_cell{bits}", _prefix(bits)).join(entry, f"_cell{bits}", "left").drop(f"_cell{bits}")
        found = F.col(f"_e{bits}") if found is None else F.coalesce(found, F.col(f"_e{bits}"))
    rows = rows.withColumn("_e", found)
    name = F.when(F.col("_e._depth") == 0, F.lit("")).otherwise(
        F.expr(f"substring(lpad(bin(_h), {BITS}, '0'), 1, _e._depth)")
    )
    over = (F.col("_e.shard_bytes") > limit) & (F.col("_e.shard_docs") > 1)
    salt = F.when(over, F.expr("shiftright(_row, 33)")).otherwise(F.lit(-1))
    rows = rows.withColumn("_salt", salt).withColumn("shard", name)
    fit = rows.filter(~over).withColumn("_part", F.lit(None).cast("string"))
    # Rows of one id may differ in length, so a part closes once it could overflow.
    run = Window.partitionBy("shard", "_salt")
    cut = rows.filter(over).withColumn("_max", F.max("n_bytes").over(run)).withColumn(
        "_at", F.row_number().over(run.orderBy("n_bytes", "_row"))
    )
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_max", F.lit(1))))
    cut = cut.withColumn("_part", F.concat_ws("-", F.lit(""), "_salt", F.floor((F.col("_at") - 1) / each).cast("string"))).drop("_max", "_at")
    both = fit.unionByName(cut).withColumn("shard", F.concat("shard", F.coalesce("_part", F.lit(""))))
    replaced = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
    return both.select(
        *(F.col(own).alias(c) for c, own in names.items() if c not in replaced), "n_bytes", "shard", F.col("_e._depth").alias("depth"),
        F.col("_e.shard_bytes").alias("shard_bytes"), F.col("_e.shard_docs").alias("shard_docs"),
    )


def write_shards(docs: DataFrame, limit: int, path: str | None = None) -> str:
    """Write one folder per shard; returns the path."""
    path = path or new_table_path(docs.sparkSession, "shards")
    sharded = assign_shards(docs, limit)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
    return path
