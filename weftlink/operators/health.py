"""Health of probed URLs: per URL, per batch, as JSON, per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .numbering import number_rows

PASS, FAIL = "pass", "fail"


def verdict(failures: Column) -> Column:
    return F.when(failures > 0, F.lit(FAIL)).otherwise(F.lit(PASS))


def probe_error(status: Column) -> Column:
    """Error text of a probe; empty for success."""
    return (
        F.when(status.isNull(), F.lit("no response"))
        .when(status >= 400, F.concat(F.lit("status "), status.cast("string")))
        .otherwise(F.lit(""))
    )


def health_per_url(probes: DataFrame) -> DataFrame:
    """``(url, status, duration_ms, pages_visited, failures, errors)`` per URL.

    ``errors`` lists the distinct messages, in order, joined by a line break.
    """
    counted = (
        probes.withColumn("error", probe_error(F.col("status")))
        .groupBy("url", "error")
        .agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    )
    failed = F.col("error") != ""
    return (
        counted.groupBy("url")
        .agg(
            F.sum("ms").alias("duration_ms"),
            F.sum("n").alias("pages_visited"),
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failures"),
            F.array_join(F.sort_array(F.collect_list(F.when(failed, F.col("error")))), "\n").alias("errors"),
        )
        .select("url", verdict(F.col("failures")).alias("status"), "duration_ms", "pages_visited", "failures", "errors")
    )


def health_batch(per_url: DataFrame) -> DataFrame:
    """One row: the batch passes only if every URL does."""
    failed = F.count_if(F.col("status") == FAIL)
    return per_url.agg(verdict(failed).alias("status"), F.count("*").alias("urls"), failed.alias("failed"))


def health_json(per_url: DataFrame) -> DataFrame:
    """One JSON result per URL: ``(url, result)``.

    A batch document is these rows under the batch status; they stay rows, so a
    batch of any size is written by many tasks.
    """
    errors = F.when(
        F.col("errors") != "",
        F.transform(F.split("errors", "\n"), lambda m: F.struct(m.alias("message"))),
    )
    result = F.struct("url", "status", "duration_ms", "pages_visited", errors.alias("errors"))
    return per_url.select("url", F.to_json(result).alias("result"))


def health_document(per_url: DataFrame) -> DataFrame:
    """``(position, text)``: lines that in the order of ``position`` are one JSON document of the batch.

    Its ``results`` are ordered by URL. The lines are numbered over all tasks,
    so that no task holds the document.
    """
    spark = per_url.sparkSession
    per_url = stash(per_url, "health")
    rows = health_json(per_url).withColumn("all", F.lit(0))
    batch = health_batch(per_url).first()
    last = batch["urls"]
    lines = number_rows(rows, "all", "url", "position")
    lines = lines.select("position", F.concat("result", F.when(F.col("position") < last, F.lit(",")).otherwise(F.lit(""))).alias("text"))
    head = f'{{"status":"{batch["status"]}","results":['
    return lines.unionByName(spark.createDataFrame([(0, head), (last + 1, "]}")], "position long, text string"))


def write_health_document(per_url: DataFrame, path: str) -> None:
    """Write the document as text parts: one after the other, in the order of their names, they are the document."""
    health_document(per_url).orderBy("position").select("text").write.text(path)


def window_counts(probes: DataFrame, interval: str) -> DataFrame:
    """``(window_start, probes, failures)`` per run; works on streams as well."""
    failed = probe_error(F.col("status")) != ""
    return (
        probes.groupBy(F.window("ts", interval).alias("w"))
        .agg(F.count("*").alias("probes"), F.count_if(failed).alias("failures"))
        .select(F.col("w.start").alias("window_start"), "probes", "failures")
    )


def health_windows(counts: DataFrame) -> DataFrame:
    """Status of each run, and whether it was reached.

    Repeated checks stop at the first failing run: later runs are not reached.
    """
    judged = counts.withColumn("status", verdict(F.col("failures")))
    first = judged.filter(F.col("status") == FAIL).agg(F.min("window_start")).scalar()
    reached = F.coalesce(F.col("window_start") <= first, F.lit(True))
    return judged.select("window_start", "status", "probes", "failures", reached.alias("reached"))
