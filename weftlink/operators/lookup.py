"""Attach one row per key to a large table without overloading any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash

BROADCAST_LIMIT = 64 * 1024 * 1024
# A key is hot when it holds more than this share of all rows; so at most
# ``1 / HOT_SHARE`` keys can be hot, which bounds the broadcast list of them.
HOT_SHARE = 1 / 1000
SALTS = 64


def text_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text; an upper guide to its broadcast size."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return df.agg(size.alias("n")).first()["n"] or 0


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """Keys above ``HOT_SHARE`` of all rows; at most ``1 / HOT_SHARE`` of them."""
    per_key = facts.groupBy(key).agg(F.count("*").alias("n"))
    total = facts.count()
    return per_key.filter((F.col("n") > total * HOT_SHARE) & (F.col("n") > SALTS)).select(key)


def attach(
    facts: DataFrame, dims: DataFrame, key: str, spread: str, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Left join ``dims`` (one row per ``key``) onto ``facts``.

    ``dims`` is written once and measured. Below the limit it is broadcast and
    ``facts`` is not shuffled. Above it, the rows of hot keys are spread over
    salts by ``spread``, a column that differs between rows of one key.
    """
    dims = stash(dims, "lookup")
    if text_bytes(dims) <= broadcast_limit:
        return facts.join(F.broadcast(dims), key, "left")
    return salted_join(facts, dims, key, spread)


def salted_join(facts: DataFrame, dims: DataFrame, key: str, spread: str) -> DataFrame:
    hot = F.broadcast(stash(hot_keys(facts, key), "hot").withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_facts = facts.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    salted_dims = dims.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_facts.join(salted_dims, [key, "_salt"], "left").drop("_salt")
