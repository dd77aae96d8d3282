"""Reports over links and page results that need no crawl order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .lookup import attach

NO_RESPONSE = "no response"
NO_BODY = "no body"


def status_text(status: Column) -> Column:
    return F.concat(F.lit("status "), status.cast("string"))


def check_errors(checked: DataFrame) -> DataFrame:
    """Error rows of checked URLs: ``(source, target, type, message, status)``.

    ``checked`` has ``source``, ``target`` and a ``status`` that is NULL where
    the target gave no response; and ``unread``, if bodies were asked for, true
    where an answer's body could not be read, which counts before its status.
    """
    missing = F.col("status").isNull()
    unread = ~missing & F.col("unread") if "unread" in checked.columns else F.lit(False)
    return checked.filter(missing | unread | (F.col("status") >= 400)).select(
        "source",
        "target",
        F.when(missing, F.lit("request")).when(unread, F.lit("read")).otherwise(F.lit("http")).alias("type"),
        F.when(missing, F.lit(NO_RESPONSE)).when(unread, F.lit(NO_BODY)).otherwise(status_text(F.col("status"))).alias("message"),
        F.when(missing | unread, F.lit(0)).otherwise(F.col("status")).cast("int").alias("status"),
    )


def broken_links(links: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every link whose target fails, with its page.

    Targets are checked once each, not once per link. The broken ones then go
    back to the links: broadcast if they are few, else with hot targets salted.
    """
    links = stash(links, "links")
    targets = links.filter(F.col("link_type") == "internal").select(F.col("link_url").alias("target")).distinct()
    statuses = snapshot.select(F.col("url").alias("target"), "status")
    bad = check_errors(targets.join(statuses, "target", "left").withColumn("source", F.col("target"))).drop("source")
    internal = links.filter(F.col("link_type") == "internal").select(
        F.col("page_url").alias("source"), F.col("link_url").alias("target")
    )
    found = attach(internal, bad, "target", spread="source").filter(F.col("type").isNotNull())
    return found.select("source", "target", "type", "message", "status")


def snapshot_fetch(urls: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Fetch URLs from the snapshot: ``(url, status, error, body_chars)``."""
    known = snapshot.select("url", "status", F.length("html").cast("bigint").alias("body_chars"))
    return urls.join(known, "url", "left").select(
        "url",
        F.coalesce("status", F.lit(0)).cast("int").alias("status"),
        F.when(F.col("status").isNull(), F.lit(NO_RESPONSE)).otherwise(F.lit("")).alias("error"),
        F.coalesce("body_chars", F.lit(0)).alias("body_chars"),
    )


def merge_page_saves(saves: DataFrame) -> DataFrame:
    """One row per URL: the last non-empty value of each field, by ``seq``.

    Fields are the status, the error, the links, the time it took, the Markdown
    path and the skip reason, links and time if ``saves`` has them; once a path
    is known the reason is empty.
    """

    def last(field: str, empty: object) -> Column:
        filled = F.size(field) > 0 if field == "links" else F.col(field) != empty
        present = F.when(filled, F.col(field))
        none = F.array().cast(saves.schema[field].dataType) if field == "links" else F.lit(empty)
        return F.coalesce(F.max_by(present, F.when(present.isNotNull(), F.col("seq"))), none).alias(field)

    fields = {"status": 0, "error": "", "links": None, "retrieved_ms": 0, "markdown_path": "", "skip_reason": ""}
    merged = saves.groupBy("url").agg(*(last(field, empty) for field, empty in fields.items() if field in saves.columns))
    reason = F.when(F.col("markdown_path") != "", F.lit("")).otherwise(F.col("skip_reason"))
    return merged.withColumn("skip_reason", reason)
