"""Crawls of many sites in one loop: each start URL has a run of its own.

The frontier is keyed by (start, url). A level is one round for all sites that
are still going: links of the frontier's pages, less what a site knows already,
numbered per site in the order of arrival. A site leaves the loop when it finds
nothing new or its page cap is full.

Links and admitted URLs are bucketed tables, so a level shuffles its frontier
and the links found, never the graph nor what is known. The order of arrival is
two numbers, the linking page's place in its level and the link's in its page.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.health import verdict
from ..operators.links import links_of_runs, start_url_check
from ..operators.lookup import BROADCAST_LIMIT, text_bytes
from ..operators.numbering import number_rows
from ..operators.reports import NO_RESPONSE, status_text
from ..operators.robots import BLOCKED, USER_AGENT, robots_rules, rule_lists, with_verdict
from ..session import delete_path, new_table_path, stash

_KEY = ("start", "url")


@dataclass(frozen=True)
class SiteParams:
    """Parameters of every run; ``max_pages`` 0 and ``max_depth`` -1 mean no limit."""

    max_pages: int = 0
    max_depth: int = -1
    allowed_extensions: list[str] | None = None
    user_agent: str = USER_AGENT


@dataclass
class SitesRun:
    """Finished crawls of many starts, read from their tables."""

    params: SiteParams
    starts: DataFrame
    refused: DataFrame
    snapshot: DataFrame
    links: _Bucketed
    known: _Bucketed
    spark: SparkSession = field(repr=False)

    @property
    def admitted(self) -> DataFrame:
        """``(start, url, depth, place, allowed)``; ``place`` counts from 1 in each site's level."""
        return self.known.read()

    def pages(self) -> DataFrame:
        """``(start, url, depth, place, allowed, status)``; 0 for pages without a response."""
        answers = self.snapshot.select("url", F.col("status").alias("answer"))
        joined = self.admitted.join(answers, "url", "left")
        status = F.when(F.col("allowed"), F.coalesce("answer", F.lit(0))).otherwise(F.lit(0))
        return joined.select(*_KEY, "depth", "place", "allowed", status.cast("int").alias("status"))

    def report(self) -> DataFrame:
        """``(start, url, depth, status, error)`` of every admitted page."""
        error = (
            F.when(~F.col("allowed"), F.lit(BLOCKED))
            .when(F.col("status") == 0, F.lit(NO_RESPONSE))
            .when(F.col("status") >= 400, status_text(F.col("status")))
            .otherwise(F.lit(""))
        )
        return self.pages().select(*_KEY, "depth", "status", error.alias("error"))

    def health(self) -> DataFrame:
        """``(url, status, duration_ms, pages_visited, failures, errors)`` of every start, refused ones with their reason.

        A start passes if all its visited pages answer without an error;
        ``errors`` lists the distinct messages, in order, joined by a line break.
        """
        times = self.snapshot.select("url", "retrieved_ms")
        visited = self.report().filter(F.col("error") != BLOCKED).join(times, "url", "left")
        failed = F.col("error") != ""
        counted = visited.groupBy("start", "error").agg(F.count("*").alias("n"), F.sum("retrieved_ms").alias("ms"))
        per_start = counted.groupBy("start").agg(
            F.coalesce(F.sum("ms"), F.lit(0)).alias("duration_ms"),
            F.sum("n").alias("pages_visited"),
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failures"),
            F.array_join(F.sort_array(F.collect_list(F.when(failed, F.col("error")))), "\n").alias("errors"),
        )
        none = F.lit(0).cast("long")
        per_start = self.starts.select("start").join(per_start, "start", "left").select(
            F.col("start").alias("url"),
            *(F.coalesce(c, none).alias(c) for c in ("duration_ms", "pages_visited", "failures")),
            F.coalesce("errors", F.lit("")).alias("errors"),
        )
        refused = self.refused.select(
            "url", none.alias("duration_ms"), none.alias("pages_visited"), F.lit(1).cast("long").alias("failures"), F.col("reason").alias("errors")
        )
        both = per_start.unionByName(refused)
        return both.select("url", verdict(F.col("failures")).alias("status"), "duration_ms", "pages_visited", "failures", "errors")

    def stats(self) -> DataFrame:
        """``(start, pages, visited, blocked, broken, levels, capped)``, a row for each start that was crawled."""
        pages = self.pages()
        broken = F.col("allowed") & ((F.col("status") == 0) | (F.col("status") >= 400))
        per_start = pages.groupBy("start").agg(
            F.count("*").alias("pages"),
            F.count_if("allowed").alias("visited"),
            F.count_if(~F.col("allowed")).alias("blocked"),
            F.count_if(broken).alias("broken"),
            (F.max("depth") + 1).alias("levels"),
        )
        capped = F.col("pages") >= self.params.max_pages if self.params.max_pages > 0 else F.lit(False)
        return per_start.withColumn("capped", capped)

    def close(self) -> None:
        """Drop the tables with their files."""
        self.links.drop()
        self.known.drop()


class _Bucketed:
    """A table in the shared folder, bucketed as the session shuffles, that rounds append to."""

    def __init__(self, spark: SparkSession, name: str, keys: tuple[str, ...]):
        self.spark, self.keys = spark, keys
        self.name = f"weftlink_{name}_{uuid.uuid4().hex}"
        self.path = new_table_path(spark, name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, *self.keys)
        writer = dealt.write.bucketBy(self.buckets, *self.keys).option("path", self.path).mode("append")
        writer.format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def canonical_starts(urls: DataFrame, allowed_extensions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(start, host)`` of the distinct canonical starts among ``urls`` (url); and ``(url, reason)`` of the others."""
    given = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    bare = ~F.col("url").contains("://") & (F.col("url") != "")
    given = given.select("url", F.when(bare, F.concat(F.lit("https://"), F.ltrim(F.col("url"), F.lit("/")))).otherwise(F.col("url")).alias("full"))
    reasons = start_url_check(given.select(F.col("full").alias("url"))).select(F.col("url").alias("full"), "reason")
    start = U.canonical_url(F.col("full"), U.split_url(F.col("full")))
    checked = given.join(reasons.distinct(), "full").withColumn("start", F.when(F.col("reason") == "", start))
    crawled = F.col("start").isNotNull() & U.has_allowed_extension(F.col("start"), allowed_extensions)
    checked = stash(checked.withColumn("ok", F.coalesce(crawled, F.lit(False))), "starts")
    extension = F.when(F.col("reason") == "", F.lit("extension not allowed")).otherwise(F.col("reason"))
    starts = checked.filter("ok").select("start", U.host_of(F.col("start")).alias("host")).distinct()
    return starts, checked.filter("NOT ok").select("url", extension.alias("reason"))


def crawl_sites(
    snapshot: DataFrame,
    start_urls: DataFrame,
    params: SiteParams = SiteParams(),
    robots_txt: DataFrame | None = None,
    visited: DataFrame | None = None,
) -> SitesRun:
    """Crawl ``snapshot`` (``url, status, html``) from every URL of ``start_urls`` (``url``).

    Runs don't meet: two starts on one host have a run each, with own caps, order
    and known URLs. Of URLs that spell one start differently a single run
    remains; what can't be a start is listed with its reason. URLs of ``visited``
    are skipped, but for the starts.
    """
    spark = snapshot.sparkSession
    starts, refused = canonical_starts(start_urls, params.allowed_extensions)
    rules = None
    if robots_txt is not None:
        # One row for each host of a start; sent to all tasks while they are few.
        lists = rule_lists(robots_rules(robots_txt), params.user_agent)
        rules = stash(lists.join(starts.select(F.col("host").alias("robots_host")).distinct(), "robots_host", "left_semi"), "robots")
        rules = F.broadcast(rules) if text_bytes(rules) <= BROADCAST_LIMIT else rules

    links = _Bucketed(spark, "site_links", ("start", "page_url"))
    pages = snapshot.select("url", "html", U.host_of(F.col("url")).alias("host")).join(starts, "host")
    followed = links_of_runs(pages).filter(
        (F.col("link_type") == "internal") & U.has_allowed_extension(F.col("link_url"), params.allowed_extensions)
    )
    links.append(followed.select("start", "page_url", "link_url", "pos"))

    known = _Bucketed(spark, "site_pages", _KEY)
    run = SitesRun(params, starts, refused, snapshot, links, known, spark)
    found = starts.select("start", F.col("start").alias("url"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("pos"))
    depth = 0
    while True:
        level = _admit(found, known.read() if depth else None, rules, depth, params)
        known.append(level.drop("going"))
        going = level.filter("going")
        if 0 <= params.max_depth <= depth or going.isEmpty():
            return run
        found = stash(_found(links.read(), going, known.read(), visited), "found")
        depth += 1


def _admit(found: DataFrame, known: DataFrame | None, rules: DataFrame | None, depth: int, params: SiteParams) -> DataFrame:
    """``(start, url, depth, place, allowed, going)``: numbered per site, cut at its cap, judged.

    ``going`` pages have links to follow: allowed ones of sites with room left.
    """
    order = F.struct("before", "pos")
    placed = number_rows(found.select(*_KEY, order.alias("order")), "start", "order", "place").drop("order")
    room = F.lit(True)
    if params.max_pages > 0:
        counts = placed.groupBy("start").agg(F.count("*").alias("n"))
        counts = counts.withColumn("total", F.lit(0)) if known is None else counts.join(known.groupBy("start").agg(F.count("*").alias("total")), "start")
        left = counts.select("start", "n", (F.lit(params.max_pages) - F.col("total")).alias("left"))
        placed = placed.join(left, "start").filter(F.col("place") <= F.col("left"))
        room = F.col("n") < F.col("left")
    placed = placed.select(*_KEY, F.lit(depth).alias("depth"), "place", room.alias("room"))
    if rules is None:
        judged = placed.withColumn("allowed", F.lit(True))
    else:
        judged = with_verdict(placed.withColumn("robots_host", U.host_of(F.col("url"))).join(rules, "robots_host", "left"))
    columns: list[Column | str] = [*_KEY, "depth", "place", "allowed", (F.col("allowed") & F.col("room")).alias("going")]
    return stash(judged.select(*columns), "level")


def _found(links: DataFrame, going: DataFrame, known: DataFrame, visited: DataFrame | None) -> DataFrame:
    """URLs that the pages of ``going`` link and their site doesn't know, with the first link's place."""
    origin = going.select("start", F.col("url").alias("page_url"), F.col("place").alias("before"))
    first = F.min(F.struct("before", "pos")).alias("first")
    met = links.join(origin, ["start", "page_url"]).groupBy("start", F.col("link_url").alias("url")).agg(first)
    fresh = met.join(known.select(*_KEY), list(_KEY), "left_anti")
    if visited is not None:
        fresh = fresh.join(visited.select("url"), "url", "left_anti")
    return fresh.select(*_KEY, "first.before", "first.pos")
