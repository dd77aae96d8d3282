"""Streaming forms of the stateful jobs.

Each job reads a stream and writes tables to the shared folder. ``run_*`` feeds
a table through its job to the end and reads the result back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.health import window_counts
from ..session import new_table_path
from .boilerplate import BoilerplateStream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 16


BATCHES = 3


def arrivals(table: DataFrame, order: str, batches: int = BATCHES) -> Iterator[DataFrame]:
    """The stream of a shared folder, anew after each part of ``table``, in ``order``, has arrived there.

    A part is written by all tasks. A job that is run on each stream in turn, with
    one progress folder, takes every part as a batch of its own and goes on where
    it stopped.
    """
    spark = table.sparkSession
    path = new_table_path(spark, "source")
    cuts = table.approxQuantile(order, [i / batches for i in range(1, batches)], 0.01) or [0.0] * (batches - 1)
    part = sum((F.when(F.col(order) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for i in range(batches):
        table.filter(part == i).write.mode("append").parquet(path)
        yield folder_stream(spark, path, table.schema)


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_end(writer: DataStreamWriter, spark: SparkSession, progress: str | None = None) -> None:
    """Process all that is available now, with state kept outside the heap.

    A job that names its ``progress`` folder again goes on where it stopped.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    where = progress or new_table_path(spark, "progress")
    query = writer.option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def new_urls(stream: DataFrame, spread: str) -> DataFrame:
    """Each URL once, when first seen.

    A URL that is everywhere is first deduplicated per salt, so that no task
    meets more than one row of it per salt.
    """
    salted = stream.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.dropDuplicates(["url", "salt"]).dropDuplicates(["url"]).select("url")


def write_new_urls(links: DataFrame, out: str, progress: str | None = None) -> DataFrame:
    """Append the new URLs of a stream of ``(url, page_url)`` to the table ``out``; gives that table."""
    spark = links.sparkSession
    fresh = new_urls(links, spread="page_url")
    run_to_end(fresh.writeStream.format("parquet").option("path", out).outputMode("append"), spark, progress)
    return spark.read.schema("url string").parquet(out)


def run_new_urls(links: DataFrame, order: str) -> DataFrame:
    out, progress = (new_table_path(links.sparkSession, name) for name in ("new-urls", "progress"))
    return [write_new_urls(stream, out, progress) for stream in arrivals(links, order)][-1]


def write_window_counts(probes: DataFrame, interval: str, lateness: str, out: str, progress: str | None = None) -> DataFrame:
    """Windowed counts of a stream of probes; those later than ``lateness`` are left out.

    Every micro-batch writes the windows it changed under its own number, so a
    repeated batch overwrites itself; the last version of a window counts.
    """
    spark = probes.sparkSession
    counts = window_counts(probes.withWatermark("ts", lateness), interval)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_to_end(counts.writeStream.outputMode("update").foreachBatch(write), spark, progress)
    versions = spark.read.schema(f"{_ddl(counts)}, batch bigint").parquet(out)
    latest = versions.groupBy("window_start").agg(F.max_by(F.struct("probes", "failures"), "batch").alias("v"))
    return latest.select("window_start", "v.probes", "v.failures")


def run_window_counts(probes: DataFrame, interval: str, lateness: str, order: str) -> DataFrame:
    out, progress = (new_table_path(probes.sparkSession, name) for name in ("windows", "progress"))
    return [write_window_counts(stream, interval, lateness, out, progress) for stream in arrivals(probes, order)][-1]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def strip_stream(stream: DataFrame, folder: str | None = None, progress: str | None = None) -> DataFrame:
    """Run a stream of ``(host, ord, text)`` through boilerplate removal, with its state and output in ``folder``."""
    spark = stream.sparkSession
    job = BoilerplateStream(spark, folder=folder)
    run_to_end(stream.writeStream.foreachBatch(job.process), spark, progress)
    return job.output()


def run_boilerplate(pages: DataFrame) -> DataFrame:
    folder, progress = (new_table_path(pages.sparkSession, name) for name in ("boilerplate-stream", "progress"))
    return [strip_stream(stream, folder, progress) for stream in arrivals(pages, "ord")][-1]
