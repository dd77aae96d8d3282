"""Boilerplate removal over arriving pages.

The state of a host is a row: pages seen, header and footer state, the last
pages' blocks, and the confirmed rule. Each micro-batch folds its pages with
the same parallel maps as the batch job, starting from that row, and writes the
next version of the state table. A host with most of the pages is therefore
spread over tasks here too, which a keyed state operator would not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boilerplate as B
from ..operators.lookup import attach
from ..operators.numbering import number_rows
from ..session import delete_path, new_table_path, stash

_RECENT = "array<struct<rn:bigint,ord:bigint,header:string,footer:string>>"
_STATE = (
    f"host string, seen bigint, header_state bigint, footer_state bigint, recent {_RECENT}, "
    "header string, header_at bigint, footer string, footer_at bigint"
)
_OUTPUT = "host string, ord bigint, text string"
# A rule known before a batch began binds all of the batch's pages.
_ALWAYS = -(1 << 63)


class BoilerplateStream:
    """``process`` is a ``foreachBatch`` function over ``(host, ord, text)``."""

    def __init__(self, spark: SparkSession, run: int = B.RUN, folder: str | None = None):
        self.spark = spark
        self.run = run
        self.folder = folder or new_table_path(spark, "boilerplate")

    def _state(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.folder}/state-{batch_id}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Strip a batch and write state version ``batch_id``.

        Reads version ``batch_id - 1`` and overwrites its own output, so a
        repeated batch gives the same tables.
        """
        pages = stash(batch.select("host", "ord", "text"), "arrived")
        before = self._state(batch_id - 1)
        self._advance(pages, before).write.mode("overwrite").parquet(f"{self.folder}/state-{batch_id}")
        state = self._state(batch_id)
        known = before.select("host", F.col("header_at").alias("had_header"), F.col("footer_at").alias("had_footer"))
        rules = state.join(known, "host", "left").select(
            "host",
            "header",
            F.when(F.col("had_header").isNotNull(), F.lit(_ALWAYS)).otherwise(F.col("header_at")).alias("header_at"),
            "footer",
            F.when(F.col("had_footer").isNotNull(), F.lit(_ALWAYS)).otherwise(F.col("footer_at")).alias("footer_at"),
        )
        stripped = B.strip_boilerplate(pages, rules)
        out = stripped.select("host", "ord", F.col("stripped").alias("text"))
        out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
        delete_path(self.spark, f"{self.folder}/state-{batch_id - 2}")

    def _advance(self, pages: DataFrame, before: DataFrame) -> DataFrame:
        fresh = number_rows(B.page_blocks(pages), "host", "ord")
        seen = before.select("host", "seen")
        placed = attach(fresh, seen, "host", spread="ord").select(
            "host",
            (F.col("rn") + F.coalesce("seen", F.lit(0))).alias("rn"),
            "ord",
            "header",
            "footer",
            F.lit(False).alias("context"),
        )
        recent = before.select("host", F.explode("recent").alias("r")).select("host", "r.*", F.lit(True).alias("context"))
        blocks = stash(placed.unionByName(recent), "blocks")

        maps = B.host_maps(B.page_maps(blocks, self.run), self.run)
        starts = before.select(
            "host", F.col("header_state").alias("header_before"), F.col("footer_state").alias("footer_before")
        )
        moved = B.states_after(maps.join(starts, "host", "left").fillna(0, ["header_before", "footer_before"]))
        ends = blocks.groupBy("host").agg(F.max("rn").alias("seen"))
        # Hosts without a page in this batch keep their state.
        states = ends.join(moved, "host", "left").join(
            before.select("host", F.col("header_state").alias("h"), F.col("footer_state").alias("f")), "host", "left"
        )
        states = states.select(
            "host",
            "seen",
            F.coalesce("header_state", "h").alias("header_state"),
            F.coalesce("footer_state", "f").alias("footer_state"),
        )
        tail = F.sequence(F.greatest(F.col("seen") - (B.CONFIRM_COUNT - 1), F.lit(1)), F.col("seen"))
        last = states.select("host", F.explode(tail).alias("rn")).join(blocks.drop("context"), ["host", "rn"])
        recents = last.groupBy("host").agg(F.collect_list(F.struct("rn", "ord", "header", "footer")).alias("recent"))
        found = B.rules_of(states, blocks.drop("context"))
        old = before.select("host", *[F.col(c).alias(f"old_{c}") for c in ("header", "header_at", "footer", "footer_at")])
        joined = states.join(recents, "host", "left").join(found, "host", "left").join(old, "host", "left")
        return joined.select(
            "host",
            "seen",
            "header_state",
            "footer_state",
            "recent",
            *[F.coalesce(f"old_{c}", c).alias(c) for c in ("header", "header_at", "footer", "footer_at")],
        )

    def output(self) -> DataFrame:
        """All stripped pages so far: ``(host, ord, text)``."""
        return self.spark.read.schema(f"{_OUTPUT}, batch bigint").parquet(f"{self.folder}/out").drop("batch")
