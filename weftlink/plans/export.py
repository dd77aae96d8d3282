"""Export of page Markdown: text, boilerplate, hash, unchanged check, document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.markdown import document, page_markdown
from ..functions.text import content_hash, remembered, word_count
from ..operators.boilerplate import boilerplate_rules, strip_boilerplate
from ..operators.links import with_link_counts
from ..operators.numbering import number_rows
from ..operators.reports import status_text
from ..session import stash
from ..sources.tables import UNCHANGED


@remembered
def _markdown(html: str, url: str) -> Column:
    return page_markdown(F.col(html), U.split_url(F.col(url)))


def page_markdowns(pages: DataFrame) -> DataFrame:
    """``pages`` with a ``markdown`` column; empty for pages without text."""
    return pages.withColumn("markdown", _markdown("html", "url"))


def page_texts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``: stripped Markdown, or the fallback document.

    Needs ``url``, ``html`` and ``ord``. The Markdown is written once, since
    both the search for boilerplate and its removal read it.
    """
    converted = page_markdowns(pages).withColumn("host", U.host_of(F.col("url")))
    fallback = F.when(F.col("markdown") == "", H.fallback_document(F.col("html")))
    kept = stash(converted.withColumn("fallback", fallback).drop("html"), "markdown")
    source = kept.withColumnRenamed("markdown", "text")
    rules = boilerplate_rules(source.select("host", "ord", "text"))
    stripped = strip_boilerplate(source, rules)
    return stripped.withColumn("text", F.coalesce("fallback", "stripped")).drop("fallback", "stripped")


def exports(pages: DataFrame, start_url: str | None = None) -> DataFrame:
    """One document row per page.

    ``pages`` has ``url, html, ord, status, retrieved_ms, fetched_at``. Links are
    counted in the page's own row, so documents meet no link table.
    """
    counted = page_texts(with_link_counts(pages, start_url))
    error = F.when(F.col("status") >= 400, status_text(F.col("status"))).otherwise(F.lit(""))
    hashed = counted.withColumn("content_sha256", content_hash(F.col("text"))).withColumn(
        "word_count", word_count(F.col("text"))
    )
    doc = document(
        F.col("url"),
        F.col("status"),
        F.col("retrieved_ms"),
        F.col("fetched_at"),
        F.col("content_sha256"),
        F.col("word_count"),
        F.col("internal_links"),
        F.col("external_links"),
        error,
        F.col("text"),
    )
    return hashed.select(
        "host",
        U.export_path(F.col("url")).alias("path"),
        "ord",
        "url",
        "content_sha256",
        "word_count",
        "internal_links",
        "external_links",
        doc.alias("content"),
    )


def crawl_exports(run) -> DataFrame:
    """One document row per page that a finished crawl fetched, in the order it arrived.

    Pages that were never reached, blocked, beyond the cap, skipped by the cache
    or without a response are no documents, and teach no boilerplate. The run's
    snapshot needs ``fetched_at``.
    """
    fetched = run.admitted.filter("allowed").select("url", "depth", "key")
    pages = run.snapshot.drop("ord").join(fetched, "url").filter(F.col("status").isNotNull())
    # Ranks over all tasks: rows are range-sorted, and each part starts where the counts before it end.
    keyed = pages.select("url", F.concat(F.lpad(F.hex("depth"), 8, "0"), F.lit(":"), "key").alias("arrival"))
    ranked = number_rows(keyed.withColumn("site", F.lit(run.start)), "site", "arrival", "ord").select("url", "ord")
    return exports(pages.drop("depth", "key").join(ranked, "url"), run.start)


def last_per_path(documents: DataFrame) -> DataFrame:
    """Pages that share a path overwrite each other: the last one stays.

    Only the overwritten rows are looked up, by ``(path, ord)``. They are few as
    a rule, and written first, so that their true size decides whether documents
    have to be shuffled to drop them.
    """
    pairs = documents.select("path", "ord")
    last = pairs.groupBy("path").agg(F.max("ord").alias("last"), F.count("*").alias("n")).filter(F.col("n") > 1)
    overwritten = pairs.join(last, "path").filter(F.col("ord") < F.col("last")).select("path", "ord")
    return documents.join(stash(overwritten, "overwritten"), ["path", "ord"], "left_anti")


def mark_unchanged(documents: DataFrame, prior: DataFrame) -> DataFrame:
    """``(url, path, content_sha256, skip_reason)`` against ``(path, content_sha256)``."""
    before = prior.select("path", F.col("content_sha256").alias("prior_sha256"))
    same = F.col("prior_sha256") == F.col("content_sha256")
    return documents.join(before, "path", "left").select(
        "url", "path", "content_sha256", F.when(same, F.lit(UNCHANGED)).otherwise(F.lit("")).alias("skip_reason")
    )


def path_collisions(urls: DataFrame) -> DataFrame:
    """Export paths shared by several URLs: ``(path, pages)``."""
    distinct = urls.select("url").distinct().select(U.export_path(F.col("url")).alias("path"))
    return distinct.groupBy("path").agg(F.count("*").alias("pages")).filter(F.col("pages") > 1)
