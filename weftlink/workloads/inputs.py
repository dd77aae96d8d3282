"""Inputs of the registered queries, derived from the given tables by Spark.

``pages`` links no page of its own table, so ``site`` adds a link structure to
every page; the other tables stand for robots files, earlier runs and probes.
All of them grow with ``pages`` or ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import spread

SITE = "https://site.example.com"
START = f"{SITE}/p/0"
EPOCH = 1704067200  # 2024-01-01T00:00:00Z

OWN_AGENT = "weftlink-bot"
SITE_ROBOTS = (
    "User-agent: *\nDisallow: /p/7\nAllow: /p/70\n\nUser-agent: other-bot\nDisallow: /\n# end\nDisallow: /orphan\n"
)
OWN_ROBOTS = f"User-agent: {OWN_AGENT}\nDisallow: /\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table, spread for text work."""
    return spread(table(spark, sf_dir, "pages"))


def _suffix(i: Column) -> Column:
    return (
        F.when(i % 11 == 10, F.lit(".pdf"))
        .when(i % 4 == 1, F.lit(".html"))
        .when(i % 4 == 2, F.lit("/"))
        .otherwise(F.lit(""))
    )


def _page_path(i: Column) -> Column:
    return F.concat(F.lit("/p/"), i.cast("string"), _suffix(i))


def site(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """One site made of all pages; without ``texts``, for jobs that read no HTML."""
    source = pages(spark, sf_dir) if texts else table(spark, sf_dir, "pages")
    i = F.col("page_id")
    right = F.concat(F.lit("//SITE.example.com/p//"), (2 * i + 2).cast("string"), _suffix(2 * i + 2), F.lit("#f"))
    ext = F.concat(F.lit("https://ext"), (i % 5).cast("string"), F.lit(".example.org/x?i="), (i % 7).cast("string"))
    added = F.concat(
        F.lit('<a href="'), _page_path(2 * i + 1), F.lit('">left</a>'),
        F.lit("<a class=x HREF='"), right, F.lit("'>right</a>"),
        F.lit("<a href=/p/0>home</a>"),
        F.lit('<a href="'), ext, F.lit('">out</a>'),
        F.lit('<a href="mailto:a@b.c">mail</a>'),
    )
    status = F.when(i % 17 == 16, F.lit(404)).when(i % 29 == 28, F.lit(500)).otherwise(F.lit(200))
    return source.select(
        "page_id",
        F.concat(F.lit(SITE), _page_path(i)).alias("url"),
        status.alias("status"),
        F.concat("html", added).alias("html"),
        (i % 400).alias("retrieved_ms"),
        F.timestamp_seconds(F.lit(EPOCH) + i).alias("fetched_at"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages by their own hosts; each links its host's first page, the next one and the fourth next."""
    host = U.host_of(F.col("url"))
    in_host = Window.partitionBy("host").orderBy("page_id")

    def path(i: Column) -> Column:
        return F.concat(F.when(i % 5 == 4, F.lit("/en/")).otherwise(F.lit("/p/")), i.cast("string"))

    def link(i: Column, label: str) -> Column:
        return F.coalesce(F.concat(F.lit('<a href="'), path(i), F.lit(f'">{label}</a>')), F.lit(""))

    ids = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    ids = ids.select("page_id", "host", *(F.lead("page_id", k).over(in_host).alias(f"next{k}") for k in (1, 4)), F.min("page_id").over(Window.partitionBy("host")).alias("first"))
    i = F.col("page_id")
    added = F.concat(link(F.col("next4"), "later"), link(F.col("next1"), "next"), link(F.col("first"), "first"))
    status = F.when(i % 17 == 16, F.lit(404)).otherwise(F.lit(200))
    return pages(spark, sf_dir).drop("url").join(ids, "page_id").select(
        F.concat(F.lit("https://"), F.col("host"), path(i)).alias("url"),
        status.alias("status"),
        F.concat("html", added).alias("html"),
        (i % 400).alias("retrieved_ms"),
        F.concat(F.lit("https://"), F.col("host"), path(F.col("first"))).alias("start"),
    )


def site_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    refresh = F.concat(F.lit('<meta http-equiv="refresh" content="0; url=/p/'), (i + 3).cast("string"), F.lit('">'))
    about = F.concat(F.lit('<meta name="description" content="About '), i.cast("string"), F.lit(' &amp; more">'))
    bare = F.concat(
        F.lit("<!doctype html><html><head><title>Empty "), i.cast("string"),
        F.lit('</title><meta name="description" content="Nothing on '), i.cast("string"),
        F.lit('."></head><body></body></html>'),
    )
    html = (
        F.when(i % 10 == 0, F.concat(refresh, F.col("html")))
        .when(i % 10 == 1, F.concat(about, F.col("html")))
        .when(i % 10 == 2, bare)
        .otherwise(F.col("html"))
    )
    return site(spark, sf_dir).withColumn("html", html)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site(spark, sf_dir).select("url", "status", "html", "retrieved_ms", "fetched_at", F.col("page_id").alias("ord"))


def external_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the external URLs that ``site`` links."""
    i = F.col("page_id")
    a, b = F.col("a"), F.col("b")
    pairs = table(spark, sf_dir, "pages").select((i % 5).alias("a"), (i % 7).alias("b")).distinct()
    return pairs.filter((a + b) % 6 != 5).select(
        F.concat(F.lit("https://ext"), a.cast("string"), F.lit(".example.org/x?i="), b.cast("string")).alias("url"),
        F.when((a * b) % 5 == 4, F.lit(404)).otherwise(F.lit(200)).alias("status"),
    )


def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt of the hosts that ``site`` pages name, and of each page's own host.

    Every host of ``pages`` has a body made from its own name and page count.
    """
    hosts = (
        table(spark, sf_dir, "pages")
        .groupBy(U.host_of(F.col("url")).alias("host"))
        .agg(F.count("*").alias("n"), F.min("page_id").alias("i"))
    )
    n, i = F.col("n").cast("string"), F.col("i").cast("string")
    own = hosts.select(
        "host",
        F.when(F.col("i") % 7 == 6, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.concat(
            F.lit("# robots of "), F.col("host"),
            F.lit("\nUser-agent: *\nUser-agent: Slow-Bot\nDisallow: /en/\nAllow: /en/"), n,
            F.lit("\nDisallow:\nUser-agent: weftlink-bot/1.0\nDisallow: /de/*"), i,
            F.lit("\nAllow: fr\n\nDisallow: /lost\nSitemap: /s.xml\n"),
        ).alias("body"),
    )
    fixed = F.explode(
        F.array(
            F.struct(F.lit("site.example.com").alias("host"), F.lit(200).alias("status"), F.lit(SITE_ROBOTS).alias("body")),
            F.struct(F.lit("ext0.example.org").alias("host"), F.lit(200).alias("status"), F.lit(OWN_ROBOTS).alias("body")),
            F.struct(F.lit("ext1.example.org").alias("host"), F.lit(404).alias("status"), F.lit(OWN_ROBOTS).alias("body")),
        )
    )
    named = spark.range(1).select(fixed.alias("r")).select("r.*")
    return own.unionByName(named)


def prior_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visited cache of an earlier run, which had seen every sixth page."""
    rows = site(spark, sf_dir, texts=False).filter(F.col("page_id") % 6 == 5)
    error = F.when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status").cast("string"))).otherwise(F.lit(""))
    return rows.select("url", "status", error.alias("error"), F.col("fetched_at").alias("last_visited"))


def prior_export_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths an earlier run had exported: every twelfth page."""
    rows = site(spark, sf_dir, texts=False).filter(F.col("page_id") % 12 == 5)
    return rows.select("page_id", "url", U.export_path(F.col("url")).alias("path"))


def bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a repeated header and footer per host: ``(host, ord, text)``."""
    i = F.col("page_id").cast("string")
    host = U.host_of(F.col("url"))
    head = F.when(F.col("page_id") % 7 == 6, F.lit("")).otherwise(F.concat(F.lit("Header "), host, F.lit("\nHome\n\n")))
    text = F.concat(head, F.lit("Page "), i, F.lit("\nbody "), i, F.lit("\n\nFooter "), host)
    return table(spark, sf_dir, "pages").select(host.alias("host"), F.col("page_id").alias("ord"), text.alias("text"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://svc"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com/")).alias("url"),
        F.when(e % 23 == 0, F.lit(503)).otherwise(F.lit(200)).alias("status"),
        (e % 500).alias("duration_ms"),
        e.alias("event_id"),
    )


def page_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")

    def on(n: int, value: Column) -> Column:
        return F.when(e % n == 0, value).otherwise(F.lit(""))

    return table(spark, sf_dir, "events").select(
        F.concat(F.lit(f"{SITE}/u/"), (F.col("user_id") % 50).cast("string")).alias("url"),
        e.alias("seq"),
        F.when(e % 3 == 0, F.lit(200)).otherwise(F.lit(0)).alias("status"),
        on(5, F.lit("status 404")).alias("error"),
        F.when(e % 9 == 0, F.array(F.concat(F.lit("/l/"), e.cast("string")), F.lit("/l"))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.when(e % 4 == 0, e % 400).otherwise(F.lit(0)).cast("long").alias("retrieved_ms"),
        on(7, F.concat(F.lit("/m/"), e.cast("string"))).alias("markdown_path"),
        on(11, F.lit("unchanged content")).alias("skip_reason"),
    )


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    line = (
        F.when(i % 7 == 6, F.lit("   "))
        .when(i % 5 == 4, F.lit("# c"))
        .when(i % 3 == 0, F.concat(F.lit("  "), bare))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select(line.alias("line"))
