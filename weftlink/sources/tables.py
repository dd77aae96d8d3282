"""Sources and sinks: URL lists, the visited cache, exported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import front_matter_hash
from ..functions.text import trim_space
from ..functions.urls import canonical_url, split_url
from ..session import child_names, delete_path, stash

UNCHANGED = "unchanged content"

VISITED_SCHEMA = "struct<visited:map<string,struct<url:string,status:int,error:string,lastVisited:timestamp>>>"


def cap_bodies(table: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Cut stored bodies to ``limit`` characters, as a live download would be; not by default."""
    return table if limit is None else table.withColumn(column, F.left(F.col(column), F.lit(limit)))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, one per line."""
    return parse_url_list(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_url_list(lines: DataFrame) -> DataFrame:
    """Skip blank and comment lines; ``https://`` for lines without a scheme."""
    trimmed = lines.select(trim_space(F.col("line")).alias("url"))
    kept = trimmed.filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    bare = ~F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    return kept.select(F.when(bare, F.concat(F.lit("https://"), F.col("url"))).otherwise(F.col("url")).alias("url"))


def canonical_snapshot(snapshot: DataFrame) -> DataFrame:
    """One row per canonical URL: the last fetch, by ``fetched_at``; of equal times the higher retrieved_ms and status.

    Raw snapshots spell a page's URL in several ways and fetch it again; URLs
    that have no canonical form are left out.
    """
    url = canonical_url(F.col("url"), split_url(F.col("url")))
    known = snapshot.withColumn("url", url).filter(F.col("url").isNotNull())
    rest = [c for c in snapshot.columns if c != "url"]
    last = F.max_by(F.struct(*rest), F.struct("fetched_at", "retrieved_ms", "status"))
    return known.groupBy("url").agg(last.alias("r")).select("url", "r.*")


def _complete_versions(spark: SparkSession, path: str) -> list[int]:
    names = [n for n in child_names(spark, path) if n.startswith("version=")]
    return sorted(int(n[8:]) for n in names if "_SUCCESS" in child_names(spark, f"{path}/{n}"))


def read_visited_json(spark: SparkSession, path: str) -> DataFrame:
    """Visited cache as ``write_visited_json`` leaves it: the newest complete version, one document a line.

    A folder or file without versions is read as lines as well; none is an empty cache.
    """
    versions = _complete_versions(spark, path)
    newest = f"{path}/version={versions[-1]:08d}" if versions else path
    return parse_visited_json(spark.read.text(newest).withColumnRenamed("value", "document"))


def read_visited_document(spark: SparkSession, path: str) -> DataFrame:
    """Visited cache from files that hold one JSON document each, over any lines.

    Whatever follows the document is an error, so a file of lines isn't read in part.
    """
    text = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    # As the one element of an array: a second document or a rest makes it malformed or longer.
    listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{VISITED_SCHEMA}>", {"mode": "FAILFAST"})
    one = F.when(F.size(listed) == 1, listed[0]).otherwise(F.raise_error(F.lit("more than one document in a file")).cast(VISITED_SCHEMA))
    return _entries(text.select(one.alias("d")))


def parse_visited_json(documents: DataFrame) -> DataFrame:
    """``(url, status, error, last_visited)``; a broken document is an error."""
    text = documents.filter(F.col("document") != "")
    parsed = text.select(F.from_json("document", VISITED_SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    return _entries(parsed)


def _entries(parsed: DataFrame) -> DataFrame:
    entries = parsed.select(F.explode("d.visited").alias("key", "entry"))
    return entries.select(
        F.col("key").alias("url"),
        F.coalesce("entry.status", F.lit(0)).alias("status"),
        F.coalesce("entry.error", F.lit("")).alias("error"),
        F.col("entry.lastVisited").alias("last_visited"),
    )


def visited_entry_json(url: Column, status: Column, error: Column, last_visited: Column) -> Column:
    """One cache document for one page; empty errors are left out."""
    entry = F.struct(
        url.alias("url"),
        status.alias("status"),
        F.when(error != "", error).alias("error"),
        F.date_format(last_visited, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("lastVisited"),
    )
    return F.to_json(F.struct(F.create_map(url, entry).alias("visited")))


def upsert_visited(prior: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest entry per URL of both tables; of entries of one time an update, then the higher status and error."""
    fields = F.struct("last_visited", "update", "status", "error")
    columns = ["url", "status", "error", "last_visited"]
    old = prior.select(*columns, F.lit(False).alias("update"))
    every = old.unionByName(updates.select(*columns, F.lit(True).alias("update")))
    latest = every.groupBy("url").agg(F.max(fields).alias("e"))
    return latest.select("url", "e.status", "e.error", "e.last_visited")


def write_visited_json(visited: DataFrame, path: str) -> None:
    """The cache as JSON lines, one entry each, as a new version under ``path``.

    Readers see it once it is complete, so a cache can be read, changed and
    written to its own path. Older versions go, except the one before.
    """
    spark = visited.sparkSession
    versions = _complete_versions(spark, path)
    number = versions[-1] + 1 if versions else 0
    document = visited_entry_json(*(F.col(c) for c in ("url", "status", "error", "last_visited")))
    visited.select(document.alias("value")).write.mode("overwrite").text(f"{path}/version={number:08d}")
    for old in versions[:-1]:
        delete_path(spark, f"{path}/version={old:08d}")


def read_export_hashes(exports: DataFrame) -> DataFrame:
    """``(path, content_sha256)`` of exported documents; unknown ones are left out."""
    hashes = exports.select("path", front_matter_hash(F.col("content")).alias("content_sha256"))
    return hashes.filter(F.col("content_sha256").isNotNull())


def current_exports(spark: SparkSession, path: str) -> DataFrame:
    """The newest document of each path: ``(path, content, version)``; empty before the first write."""
    versions = _complete_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], "path string, content string, version bigint")
    known = [f"{path}/version={v:08d}" for v in versions]
    rows = spark.read.option("basePath", path).parquet(*known)
    newest = rows.groupBy("path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["path", "version"], "left_semi").select("path", "content", F.col("version").cast("bigint").alias("version"))


def write_exports(documents: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Write new and changed documents as a further version; the others stay as they are.

    ``documents`` (one row per path) are compared by the hash in their front
    matter with what is there. Returns ``(path, skip_reason)``. Rows are spread
    by a hash of the path, so no host is a folder or a task of its own.
    """
    spark = documents.sparkSession
    versions = _complete_versions(spark, path)
    before = read_export_hashes(current_exports(spark, path)).withColumnRenamed("content_sha256", "prior_sha256")
    marked = documents.join(before, "path", "left")
    same = F.coalesce(F.col("prior_sha256") == F.col("content_sha256"), F.lit(False))
    marked = stash(marked.withColumn("skip_reason", F.when(same, F.lit(UNCHANGED)).otherwise(F.lit(""))).drop("prior_sha256"), "export")
    number = versions[-1] + 1 if versions else 0
    fresh = marked.filter(F.col("skip_reason") == "").drop("skip_reason")
    fresh.repartition(buckets, "path").write.mode("overwrite").parquet(f"{path}/version={number:08d}")
    return marked.select("path", "skip_reason")
