"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash

# Fixed value: the white space that the text contracts name.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for ``mapInArrow``, giving back freed memory at its end.

    A worker outlives its task: else it would keep what its largest batch took,
    beside the executor's other workers and the next stage's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            # Only glibc has it.
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, .. that no helper column clashes with; and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def seeded(column: str, seed: str) -> Column:
    """60 pseudo-random bits from a value and a seed, alike in every engine with MD5."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (id, component_id).

    ``component_id`` is the smallest id reachable; ids without edges don't
    appear. Each round every node hooks onto the neighbour that a fresh random
    order puts first, and edges between contracted nodes live on, so that
    chains shrink by a constant share per round. A round is two joins of the
    living edges; nothing is gathered per node but one minimum.
    """
    live = stash(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        turn = F.lit(len(hooks))
        place = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("id"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        to = F.when(place("a") < F.col("m"), F.col("a")).otherwise(F.col("m.id"))
        hook = stash(first.select(F.col("a").alias("id"), to.alias("to")), "hooks")
        hooks.append(hook)
        left = hook.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = hook.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b").filter("ta <> tb")
        live = stash(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    if not hooks:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    found = hooks[0].select("id", F.col("to").alias("root"))
    for hook in hooks[1:]:
        found = found.join(hook.withColumnRenamed("id", "root"), "root", "left").select(
            "id", F.coalesce("to", "root").alias("root")
        )
    found = stash(found, "roots")
    least = stash(found.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return found.join(least, "root").select("id", "component_id")
