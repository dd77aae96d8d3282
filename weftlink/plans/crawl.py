"""Replay of a polite breadth-first crawl over a page snapshot.

The link graph is extracted once and written bucketed by page, so each level
shuffles only its frontier, not the graph. Every level is one written table; the
driver holds nothing but row counts and the key that fills the page cap.

Order is that of first arrival: by the order of the linking page, then by link
position. A page's ``key`` spells the positions that lead to it, so within a
depth keys sort in that order without any ranking. Every few levels the pages
are sorted once and their links' keys go on from a rank, so keys stay short
however long a chain of pages is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import remembered
from ..operators.links import page_links_with_refresh
from ..operators.reports import NO_BODY, NO_RESPONSE, check_errors, status_text
from ..operators.robots import BLOCKED, USER_AGENT, robots_rules, rule_lists, with_robots, with_verdict
from ..session import delete_path, new_table_path, stash

# ``base`` is what the keys of a page's links begin with.
_LEVEL_SCHEMA = "url string, key string, base string, allowed boolean"
# Levels between two rankings.
_KEY_LEVELS = 8
# Hex digits of a link position: enough for every link a body can hold.
_POS_DIGITS = 8
# ``monotonically_increasing_id`` puts the partition above this bit and counts
# rows from 0 below it.
_PARTITION_BIT = 33


@dataclass(frozen=True)
class CrawlParams:
    """Parameters of one run; ``max_pages`` 0 and ``max_depth`` -1 mean no limit."""

    start_url: str
    allow_external: bool = False
    max_pages: int = 0
    max_depth: int = -1
    allowed_extensions: list[str] | None = None
    ignore_robots: bool = False
    user_agent: str = USER_AGENT
    exporting: bool = False


@dataclass
class Cutoff:
    """The admission that filled the page cap."""

    depth: int
    key: str


@dataclass
class CrawlRun:
    """A finished crawl and the reports read from its tables."""

    params: CrawlParams
    start: str
    snapshot: DataFrame
    links_table: str
    level_dir: str
    depths: int
    cutoff: Cutoff | None
    cached: DataFrame | None
    rules: DataFrame | None
    start_skipped: bool = False
    spark: SparkSession = field(repr=False, default=None)

    @property
    def links(self) -> DataFrame:
        """The link graph: ``(page_url, pos, link_url, link_type, ext_ok)``."""
        return self.spark.table(self.links_table)

    @cached_property
    def admitted(self) -> DataFrame:
        """``(url, depth, key, allowed)`` of every admitted URL."""
        if self.depths == 0:
            return self.spark.createDataFrame([], f"{_LEVEL_SCHEMA}, depth int")
        rows = _read_levels(self.spark, self.level_dir)
        if self.cutoff:
            rows = rows.filter((F.col("depth") < self.cutoff.depth) | (F.col("key") <= self.cutoff.key))
        return rows

    def pages(self) -> DataFrame:
        """``(url, depth, key, allowed, status, retrieved_ms, unread)``; NULL status: no response, unread: no body."""
        unread = F.col("html").isNull().alias("unread")
        known = self.snapshot.select("url", "status", "retrieved_ms", unread, F.lit(True).alias("found"))
        joined = self.admitted.join(known, "url", "left")
        seen = F.col("allowed") & F.col("found")
        return joined.select(
            "url",
            "depth",
            "key",
            "allowed",
            F.when(seen, F.col("status")).alias("status"),
            F.when(seen, F.col("retrieved_ms")).alias("retrieved_ms"),
            F.coalesce(seen & F.col("unread"), F.lit(False)).alias("unread"),
        )

    def reached(self) -> DataFrame:
        """``(url, depth, status)``; 0 for pages without a response."""
        return self.pages().select("url", "depth", F.coalesce("status", F.lit(0)).cast("int").alias("status"))

    def levels(self) -> DataFrame:
        """Admitted URLs per depth."""
        return self.admitted.groupBy("depth").agg(F.count("*").alias("pages"))

    def pages_report(self, checked_exports: DataFrame | None = None) -> DataFrame:
        """``(url, status, error, retrieved_ms, markdown_path, markdown_skipped_reason)``.

        ``checked_exports`` gives ``(url, skip_reason)`` of pages whose export
        was not written anew.
        """
        status = F.coalesce("status", F.lit(0)).cast("int")
        error = (
            F.when(~F.col("allowed"), F.lit(BLOCKED))
            .when(F.col("status").isNull(), F.lit(NO_RESPONSE))
            .when(F.col("unread"), F.lit(NO_BODY))
            .when(F.col("status") >= 400, status_text(F.col("status")))
            .otherwise(F.lit(""))
        )
        pages = self.pages()
        if checked_exports is None:
            pages = pages.withColumn("skip_reason", F.lit(None).cast("string"))
        else:
            pages = pages.join(checked_exports.select("url", "skip_reason"), "url", "left")
        exported = F.col("status").isNotNull() & F.lit(self.params.exporting)
        reason = F.when(exported, F.coalesce("skip_reason", F.lit(""))).otherwise(F.lit(""))
        return pages.select(
            "url",
            status.alias("status"),
            error.alias("error"),
            F.coalesce("retrieved_ms", F.lit(0)).cast("bigint").alias("retrieved_ms"),
            F.when(exported & (reason == ""), U.export_path(F.col("url"))).otherwise(F.lit("")).alias("markdown_path"),
            reason.alias("markdown_skipped_reason"),
        )

    def close(self) -> None:
        """Drop the link table and the levels with their files; reports can't be read afterwards."""
        where = self.spark.sql(f"DESCRIBE FORMATTED {self.links_table}").filter("col_name = 'Location'").first()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.links_table}")
        for path in ([where["data_type"]] if where else []) + [self.level_dir]:
            delete_path(self.spark, path)

    def visited(self, at: Column) -> DataFrame:
        """``(url, status, error, last_visited)`` of every admitted page, blocked and failed ones included, for the cache."""
        report = self.pages_report()
        return report.select("url", "status", "error", at.cast("timestamp").alias("last_visited"))

    def write_reports(self, path: str, external_snapshot: DataFrame | None = None) -> None:
        """Write pages, links, errors and counters as tables under ``path``."""
        reports = {
            "pages": self.pages_report(),
            "links": self.occurrences().select("page_url", "pos", "link_url", "link_type"),
            "errors": self.errors(external_snapshot),
            "stats": self.stats(external_snapshot),
        }
        for name, report in reports.items():
            report.write.mode("overwrite").parquet(f"{path}/{name}")

    def page_errors(self) -> DataFrame:
        """Errors of crawled pages; robots-blocked ones are no errors."""
        visited = self.pages().filter("allowed")
        return check_errors(visited.select(F.col("url").alias("source"), F.col("url").alias("target"), "status", "unread"))

    def occurrences(self) -> DataFrame:
        """Links of processed pages, with the depth and key they lead to."""
        origin = self.admitted.filter("allowed").select(
            F.col("url").alias("page_url"), (F.col("depth") + 1).alias("depth"), "base"
        )
        return self.links.join(origin, "page_url").withColumn("key", _next_key()).drop("base")

    def externals(self) -> DataFrame:
        """``(url, source)``: each external URL with the first page that links it."""
        if not self.params.allow_external:
            return self.spark.createDataFrame([], "url string, source string")
        first = F.min(F.struct("depth", "key", "page_url"))
        outside = self.occurrences().filter(F.col("link_type") == "external")
        return outside.groupBy(F.col("link_url").alias("url")).agg(first.alias("f")).select("url", "f.page_url").withColumnRenamed(
            "page_url", "source"
        )

    def external_check(self, external_snapshot: DataFrame) -> DataFrame:
        """``(url, source, allowed, status)`` of each external URL."""
        unique = self.externals()
        if self.rules is None:
            judged = unique.withColumn("allowed", F.lit(True))
        else:
            judged = with_robots(unique, self.rules, user_agent=self.params.user_agent)
        known = external_snapshot.select("url", "status")
        return judged.join(known, "url", "left").select(
            "url", "source", "allowed", F.when(F.col("allowed"), F.col("status")).alias("status")
        )

    def errors(self, external_snapshot: DataFrame | None = None) -> DataFrame:
        """All errors of the run: pages, then externals when they are checked."""
        out = self.page_errors()
        if external_snapshot is None:
            return out
        checked = self.external_check(external_snapshot).filter("allowed")
        return out.unionByName(check_errors(checked.select("source", F.col("url").alias("target"), "status")))

    def stats(self, external_snapshot: DataFrame | None = None) -> DataFrame:
        """One row of counters."""
        internal = F.col("link_type") == "internal"
        survivor = internal & F.col("ext_ok")
        late = F.lit(False)
        if self.cutoff:
            level = F.col("depth") == self.cutoff.depth
            late = (F.col("depth") > self.cutoff.depth) | (level & (F.col("key") > self.cutoff.key))
        too_deep = F.lit(False)
        if self.params.max_depth >= 0:
            too_deep = F.col("depth") > self.params.max_depth
        # Counted per target first: a target linked from everywhere is one row
        # per map task before it meets the visited cache.
        per_target = self.occurrences().groupBy("link_url", "link_type", "ext_ok").agg(
            F.count("*").alias("n"),
            F.count_if(survivor & too_deep).alias("deep"),
            F.count_if(survivor & ~too_deep & late).alias("late"),
        )
        if self.cached is None:
            per_target = per_target.withColumn("is_cached", F.lit(False))
        else:
            marked = self.cached.select(F.col("url").alias("link_url"), F.lit(True).alias("is_cached"))
            per_target = per_target.join(marked, "link_url", "left").fillna(False, ["is_cached"])
        hit = survivor & F.col("is_cached")
        kept = survivor & ~F.col("is_cached")
        start_skip = F.lit(1 if self.start_skipped else 0)
        totals = per_target.agg(
            _total(internal, "n", "total_internal_links"),
            _total(~internal, "n", "total_external_links"),
            (_sum(internal & ~F.col("ext_ok"), "n") + start_skip).alias("skipped_by_extension"),
            _total(hit, "n", "skipped_by_cache"),
            _total(kept, "deep", "skipped_by_depth"),
            _total(kept, "late", "skipped_by_limit"),
        )
        pages = self.admitted.agg(
            F.count_if("allowed").alias("pages_visited"),
            F.count("*").alias("unique_internal_pages"),
            F.count_if(~F.col("allowed")).alias("blocked_pages"),
        )
        if self.params.allow_external and external_snapshot is not None:
            checked = self.external_check(external_snapshot)
        else:
            checked = self.spark.createDataFrame([], "allowed boolean, status int")
        outside = checked.agg(
            F.count("*").alias("unique_external_links"),
            F.count_if(F.col("status").isNotNull()).alias("external_links_checked"),
            F.count_if(~F.col("allowed")).alias("blocked_externals"),
        )
        # Three one-row tables with columns of their own become one row.
        rows = totals.unionByName(pages, True).unionByName(outside, True)
        row = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
        return row.select(
            "pages_visited",
            "unique_internal_pages",
            "unique_external_links",
            "total_internal_links",
            "total_external_links",
            "external_links_checked",
            "skipped_by_extension",
            "skipped_by_cache",
            "skipped_by_depth",
            "skipped_by_limit",
            (F.col("blocked_pages") + F.col("blocked_externals")).alias("skipped_by_robots"),
        )


def _next_key() -> Column:
    return F.concat("base", F.lpad(F.hex("pos"), _POS_DIGITS, "0"))


def _based(level: DataFrame, depth: int) -> DataFrame:
    """Add ``base``: the key, or at every ``_KEY_LEVELS``-th depth the place in the sorted level."""
    if not depth or depth % _KEY_LEVELS:
        return level.withColumn("base", F.col("key"))
    return level.orderBy("key").withColumn("base", F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


def _sum(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def _total(condition: Column, value: str, name: str) -> Column:
    return _sum(condition, value).alias(name)


def _read_levels(spark: SparkSession, level_dir: str) -> DataFrame:
    return spark.read.schema(f"{_LEVEL_SCHEMA}, depth int").parquet(level_dir)


@remembered
def _canonical_start(raw: str) -> Column:
    return U.canonical_url(F.col(raw), U.split_url(F.col(raw)))


def _start_row(spark: SparkSession, params: CrawlParams):
    """Canonical start URL (``https`` if it has no scheme), its host, and whether it may be crawled."""
    given = params.start_url
    url = given if "://" in given else f"https://{given.lstrip('/')}"
    if not U.is_plainly_canonical(url):
        raw = spark.createDataFrame([(url,)], "raw string")
        url = raw.select(_canonical_start("raw").alias("url")).first()["url"]
    start = F.lit(url)
    ok = U.has_allowed_extension(start, params.allowed_extensions)
    return spark.range(1).select(start.alias("url"), U.host_of(start).alias("host"), ok.alias("ok")).first()


def cached_urls(
    visited: DataFrame, start: str, prior_exports: DataFrame | None = None
) -> DataFrame:
    """URLs to skip: visited earlier, and still exported if ``prior_exports`` is given."""
    urls = visited.select("url").filter(F.col("url") != start).distinct()
    if prior_exports is None:
        return urls
    placed = urls.withColumn("path", U.export_path(F.col("url")))
    return placed.join(prior_exports.select("path"), "path", "left_semi").select("url")


def link_graph(snapshot: DataFrame, start: str, params: CrawlParams) -> str:
    """Write the links of all pages once, bucketed by page; gives the table's name."""
    spark = snapshot.sparkSession
    links = page_links_with_refresh(snapshot.select("url", "html"), start).withColumn(
        "ext_ok", U.has_allowed_extension(F.col("link_url"), params.allowed_extensions)
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"weftlink_links_{uuid.uuid4().hex}"
    (
        links.repartition(buckets, "page_url")
        .write.bucketBy(buckets, "page_url")
        .sortBy("page_url")
        .option("path", new_table_path(spark, "links"))
        .saveAsTable(name)
    )
    return name


def _own_rules(rules: DataFrame | None, host: str, params: CrawlParams) -> DataFrame | None:
    """The rule lists of the start host: one row, bounded by the limit on a body."""
    if rules is None:
        return None
    return stash(rule_lists(rules, params.user_agent).filter(F.col("robots_host") == host), "robots")


def _judge(urls: DataFrame, own_rules: DataFrame | None) -> DataFrame:
    if own_rules is None:
        return urls.withColumn("allowed", F.lit(True))
    # Internal pages share the one host of ``own_rules``.
    hosted = urls.withColumn("robots_host", U.host_of(F.col("url")))
    return with_verdict(hosted.join(F.broadcast(own_rules), "robots_host", "left"))


def _cap_key(level: DataFrame, remaining: int) -> str:
    """Key of the ``remaining``-th admission of a level.

    The keys are sorted over all tasks; only row counts of the sorted parts
    come to the driver.
    """
    ranked = stash(level.select("key").orderBy("key").withColumn("id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("id", _PARTITION_BIT).alias("part")
    for index, n in sorted((r["part"], r["count"]) for r in ranked.groupBy(part).count().collect()):
        if remaining <= n:
            return ranked.filter(F.col("id") == (index << _PARTITION_BIT) + remaining - 1).first()["key"]
        remaining -= n
    raise ValueError("level holds fewer rows than the cap needs")


def crawl(
    snapshot: DataFrame,
    params: CrawlParams,
    robots_txt: DataFrame | None = None,
    visited: DataFrame | None = None,
    prior_exports: DataFrame | None = None,
) -> CrawlRun:
    """Crawl ``snapshot`` (``url, status, html, retrieved_ms``) from the start URL.

    A candidate passes extension, cache, depth, cap and seen tests in that
    order. Depth is the true breadth-first depth.
    """
    spark = snapshot.sparkSession
    start = _start_row(spark, params)
    if start["url"] is None:
        raise ValueError(f"not a start URL: {params.start_url!r}")
    # Internal pages share the start's host; others are never read for links.
    snapshot = snapshot.filter(U.host_of(F.col("url")) == start["host"])
    links = link_graph(snapshot, start["url"], params)
    rules = robots_rules(robots_txt) if robots_txt is not None and not params.ignore_robots else None
    cached = None
    if visited is not None:
        cached = stash(cached_urls(visited, start["url"], prior_exports if params.exporting else None), "cached")

    level_dir = new_table_path(spark, "levels")
    run = CrawlRun(params, start["url"], snapshot, links, level_dir, 0, None, cached, rules, spark=spark)
    if not start["ok"]:
        run.start_skipped = True
        return run

    own_rules = _own_rules(rules, start["host"], params)
    followed = spark.table(links).filter((F.col("link_type") == "internal") & F.col("ext_ok")).select("page_url", "link_url", "pos")
    fresh = spark.createDataFrame([(start["url"], "")], "url string, key string")
    total, depth = 0, 0
    while True:
        path = f"{level_dir}/depth={depth}"
        _based(_judge(fresh, own_rules), depth).select("url", "key", "base", "allowed").write.parquet(path)
        level = spark.read.schema(_LEVEL_SCHEMA).parquet(path)
        found = level.count()
        if found == 0:
            return run
        run.depths = depth + 1
        if params.max_pages > 0 and total + found >= params.max_pages:
            run.cutoff = Cutoff(depth, _cap_key(level, params.max_pages - total))
            return run
        total += found
        depth += 1
        if 0 <= params.max_depth < depth:
            return run
        known = _read_levels(spark, level_dir).select("url")
        fresh = _expand(followed, level, known if cached is None else known.unionByName(cached))


def _expand(followed: DataFrame, level: DataFrame, known: DataFrame) -> DataFrame:
    """URLs first met on the pages of ``level``, with the key of their first link.

    Dropping known URLs and repeated links is one aggregation: both sides are
    reduced per URL before they are shuffled.
    """
    origin = level.filter("allowed").select(F.col("url").alias("page_url"), "base")
    met = followed.join(origin, "page_url").select(F.col("link_url").alias("url"), _next_key().alias("key"), F.lit(False).alias("known"))
    before = known.select("url", F.lit(None).cast("string").alias("key"), F.lit(True).alias("known"))
    merged = met.unionByName(before).groupBy("url").agg(F.min("key").alias("key"), F.bool_or("known").alias("known"))
    return merged.filter(~F.col("known")).select("url", "key")
