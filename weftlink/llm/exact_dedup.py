"""Exact dedup by a distributed sort of the texts themselves.

Normalised texts are range-partitioned between sampled splitters, sorted
externally inside each range so that equal ones lie next to each other, and
compared whole with their neighbours (a window over equal texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import SPACE, text_of

# A splitter carries this many leading characters and a hash of the whole text:
# sampled splitters reach the driver, and a text can be of any length. Equality
# is always decided on the whole text.
SPLITTER_CHARS = 32
# A text with more than this share of all rows is sorted in parts: at most
# ``1 / HOT_SHARE`` texts can be hot, which bounds the list of their hashes.
HOT_SHARE = 1 / 1024
HOT_LEAST = 64
PARTS = 256


def normalised(column: str = "text"):
    """Runs of white space as one space; null as the empty text."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts the one with the smallest id is kept.
    Null text equals the empty text. Null ids sort after all others, and are
    kept only in a group that has no other id (keep_id is then null). Of rows
    that repeat the smallest id exactly one is kept. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    limit = max(docs.count() * HOT_SHARE, HOT_LEAST)
    hot = rows.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    hot = F.broadcast(stash(hot.select("_hash", F.lit(True).alias("_hot")), "hot-texts"))

    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.lit(-1))
    keyed = rows.join(hot, "_hash", "left").select(
        "doc_id", "_text", "_hash", part.cast("int").alias("_part"), F.substring("_text", 1, SPLITTER_CHARS).alias("_head")
    )
    ranged = keyed.repartitionByRange("_head", "_hash", "_part")
    equal = Window.partitionBy("_head", "_hash", "_part", "_text")
    in_order = equal.orderBy(F.col("doc_id").asc_nulls_last())
    found = ranged.select(
        "doc_id",
        "_part",
        F.min("doc_id").over(equal).alias("_least"),
        F.count("*").over(equal).alias("_size"),
        F.row_number().over(in_order).alias("_place"),
        F.sha2("_text", 256).alias("text_sha256"),
        F.when((F.col("_part") >= 0) & (F.row_number().over(in_order) == 1), F.col("_text")).alias("_lead"),
    )
    found = stash(found, "text-runs")

    # The parts of hot texts meet by their first rows: at most PARTS of each.
    whole = Window.partitionBy("_lead")
    parts = found.filter("_lead IS NOT NULL").select(
        "text_sha256",
        "_part",
        F.min("_least").over(whole).alias("_keep"),
        F.sum("_size").over(whole).alias("_total"),
        F.row_number().over(whole.orderBy(F.col("_least").asc_nulls_last(), "_part")).alias("_rank"),
    )
    joined = found.join(stash(parts, "hot-runs"), ["text_sha256", "_part"], "left")
    first = (F.col("_place") == 1) & (F.coalesce("_rank", F.lit(1)) == 1)
    return joined.select(
        "doc_id",
        F.when(F.col("_rank").isNull(), F.col("_least")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_total", "_size").alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by a number of their own, given to them once they are
    written, so repeated and null ids do no harm.
    """
    numbered = stash(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")), "numbered")
    ids = numbered.select(F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", "n").alias("doc_id"), "row.text")
    kept = exact_dedup(ids).filter("kept").select(F.col("doc_id.n").alias("n"))
    return numbered.join(kept, "n", "left_semi").select("row.*")
