"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Values a cluster has already chosen (executor
# memory, shuffle partitions, adaptive thresholds) are left alone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Rows that a Python worker gets at once: of whole texts, Spark's default number
# takes tens of MB, several times over in every worker. Another choice is kept.
BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on (UTC), that guard skew (AQE) or that bound memory."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    return spark


def local_session(cpus: int | str = 8, app: str = "weftlink") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "256")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, gets a folder
    of its own when none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftlink-"))
    return spark.sparkContext.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftlink/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like a checkpoint and survives the loss of executors; being a
    Parquet table it also gives Catalyst the true size for join planning.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table's files, wherever Spark can reach them."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none if it isn't there."""
    files, where = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that has few splits.

    Text work is bound by the processor. A table of many splits, as any large
    one is, comes back unchanged and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
