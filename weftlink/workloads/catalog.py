"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lines as L
from ..functions import urls as U
from ..functions.text import content_hash, remembered, word_count
from ..operators import boilerplate as B
from ..operators import health, links, numbering, reports, robots
from ..plans import export, sites
from ..plans.crawl import CrawlParams, CrawlRun, cached_urls, crawl
from ..session import configure
from ..sources import tables as S
from ..streaming import jobs
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return I.pages(spark, d)


# --- links of pages ---------------------------------------------------------


@query
def hrefs(spark, d):
    return links.hrefs(_pages(spark, d))


@query
def hrefs_clean(spark, d):
    return links.clean_hrefs(_pages(spark, d))


@query
def links_resolved(spark, d):
    return links.resolved_links(_pages(spark, d))


@query
def links_classified(spark, d):
    return links.classified_links(I.site(spark, d).select("url", "html"))


@query
def canonical_urls(spark, d):
    return links.canonical_urls(_pages(spark, d))


@query
def canonical_dups(spark, d):
    return links.canonical_dups(links.canonical_urls(I.site(spark, d).select("url", "html")))


@query
def page_links(spark, d):
    return links.page_links(I.site(spark, d).select("url", "html"))


@query
def link_type_counts(spark, d):
    return links.link_type_counts(links.page_links(_pages(spark, d)))


@query
def extension_filter(spark, d):
    kept = links.page_links(_pages(spark, d))
    return kept.select(
        "page_url",
        "link_url",
        U.extension_of(F.col("link_url")).alias("extension"),
        U.has_allowed_extension(F.col("link_url")).alias("allowed"),
    )


@query
def meta_refresh(spark, d):
    return I.site_meta(spark, d).select("url", H.refresh_target(F.col("html")).alias("target"))


@query
def links_with_refresh(spark, d):
    return links.page_links_with_refresh(I.site_meta(spark, d).select("url", "html"), I.START)


@query
def start_url_check(spark, d):
    # Every page's URL in five spellings: as it is, without scheme, as a
    # protocol-relative reference, under a scheme no crawl follows, and empty.
    url = F.col("url")
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    spellings = F.array(
        url, F.concat(F.lit("//"), bare), F.concat(F.lit("ftp://"), bare), F.concat(F.lit("/"), bare), F.lit("")
    )
    return links.start_url_check(_pages(spark, d).select(F.explode(spellings).alias("url")).distinct())


# --- page text --------------------------------------------------------------


@query
def page_titles(spark, d):
    return _pages(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


@query
def decoded_titles(spark, d):
    raw = F.regexp_extract("html", H.TITLE, 1)
    return _pages(spark, d).select("page_id", raw.alias("raw"), H.clean_href(raw).alias("decoded"))


@query
def page_descriptions(spark, d):
    return I.site_meta(spark, d).select("url", H.description(F.col("html")).alias("description"))


@query
def visible_text(spark, d):
    return _pages(spark, d).select("page_id", H.visible_text(F.col("html")).alias("text"))


@query
def fallback_document(spark, d):
    return I.site_meta(spark, d).select("url", H.fallback_document(F.col("html")).alias("document"))


@query
def word_counts(spark, d):
    text = _pages(spark, d).select("page_id", H.visible_text(F.col("html")).alias("text"))
    return text.select("page_id", word_count(F.col("text")).alias("words"))


@query
def content_hashes(spark, d):
    text = _pages(spark, d).select("page_id", H.visible_text(F.col("html")).alias("text"))
    return text.select("page_id", content_hash(F.col("text")).alias("content_sha256"))


QUERIES["content_hash"] = QUERIES.pop("content_hashes")


@query
def page_markdown(spark, d):
    return export.page_markdowns(I.site(spark, d)).select("url", "markdown")


# --- export -----------------------------------------------------------------


@query
def export_paths(spark, d):
    pages = _pages(spark, d).select("url", _canonical_self("url").alias("canonical"))
    return pages.select("url", U.export_path(F.col("canonical")).alias("path"))


@remembered
def _canonical_self(url):
    return U.canonical_url(F.col(url), U.split_url(F.col(url)))


@query
def export_path_collisions(spark, d):
    pages = I.site(spark, d).select("url", "html")
    targets = links.page_links(pages).filter(F.col("link_type") == "internal")
    return export.path_collisions(targets.select(F.col("link_url").alias("url")))


@query
def markdown_export(spark, d):
    docs = export.last_per_path(export.exports(I.snapshot(spark, d), I.START))
    return docs.select("host", "path", "url", "content_sha256", "word_count", "internal_links", "external_links", "content")


def _unchanged(spark, d) -> DataFrame:
    """Pages against an earlier export of every twelfth one, half of it outdated."""
    texts = export.page_texts(I.snapshot(spark, d).select("url", "html", "ord"))
    docs = texts.select("url", U.export_path(F.col("url")).alias("path"), "ord", content_hash(F.col("text")).alias("content_sha256"))
    known = F.when(F.col("ord") % 24 == 5, F.col("content_sha256")).otherwise(F.lit("stale"))
    prior = docs.filter(F.col("ord") % 12 == 5).select("path", known.alias("content_sha256"))
    return export.mark_unchanged(docs.drop("ord"), prior)


@query
def export_unchanged(spark, d):
    return _unchanged(spark, d)


@query
def frontmatter_hash(spark, d):
    # Documents composed around each page's visible text, in the shapes a
    # reader meets: plain, CRLF, no front matter, unclosed, without a hash.
    pages = I.site(spark, d)
    text = H.visible_text(F.col("html"))
    i = F.col("page_id")
    front = F.concat(F.lit("---\nurl: "), F.col("url"), F.lit("\ncontent_sha256:  "), content_hash(F.col("text")), F.lit("\n"))
    whole = F.concat(front, F.lit("---\n\n"), F.col("text"))
    content = (
        F.when(i % 5 == 1, F.replace(whole, F.lit("\n"), F.lit("\r\n")))
        .when(i % 5 == 2, F.col("text"))
        .when(i % 5 == 3, front)
        .when(i % 5 == 4, F.concat(F.lit("---\nurl: "), F.col("url"), F.lit("\n---\n\n"), F.col("text")))
        .otherwise(whole)
    )
    docs = pages.select("page_id", "url", text.alias("text")).select(U.export_path(F.col("url")).alias("path"), content.alias("content"))
    return S.read_export_hashes(docs)


@query
def header_candidates(spark, d):
    block = L.header_block(F.col("text"))
    return I.bp(spark, d).select("host", "ord", block.alias("header"), L.line_count(block).alias("lines"))


@query
def footer_candidates(spark, d):
    block = L.footer_block(F.col("text"))
    return I.bp(spark, d).select("host", "ord", block.alias("footer"), L.line_count(block).alias("lines"))


@query
def boilerplate_rules(spark, d):
    rules = B.boilerplate_rules(I.bp(spark, d))
    return rules.select(
        "host",
        F.coalesce("header", F.lit("")).alias("header"),
        F.coalesce("header_at", F.lit(-1)).alias("header_at"),
        F.coalesce("footer", F.lit("")).alias("footer"),
        F.coalesce("footer_at", F.lit(-1)).alias("footer_at"),
    )


@query
def boilerplate_stripped(spark, d):
    pages = I.bp(spark, d)
    return B.strip_boilerplate(pages, B.boilerplate_rules(pages)).select("host", "ord", F.col("stripped").alias("text"))


# --- sources ----------------------------------------------------------------


@query
def snapshot_fetch(spark, d):
    site = I.site(spark, d)
    wanted = (
        links.page_links(site.select("url", "html"))
        .filter(F.col("link_type") == "internal")
        .select(F.col("link_url").alias("url"))
        .distinct()
    )
    return reports.snapshot_fetch(wanted, site)


@query
def snapshot_canonical(spark, d):
    site = I.site(spark, d, texts=False).select("url", "status", "retrieved_ms", "fetched_at", "page_id")
    # Every third page was fetched under another spelling too, an hour before or after.
    i = F.col("page_id")
    other = site.filter(i % 3 == 0).select(
        F.concat(F.lit("HTTPS://SITE.example.com"), F.substring("url", 25, 10_000), F.lit("#top")).alias("url"),
        F.lit(203).alias("status"),
        "retrieved_ms",
        F.timestamp_seconds(F.unix_timestamp("fetched_at") + F.when(i % 6 == 0, -3600).otherwise(3600)).alias("fetched_at"),
    )
    return S.canonical_snapshot(site.drop("page_id").unionByName(other))


@query
def url_list(spark, d):
    return S.parse_url_list(I.url_lines(spark, d))


@query
def visited_load(spark, d):
    prior = I.prior_visited(spark, d)
    document = S.visited_entry_json(*(F.col(c) for c in ("url", "status", "error", "last_visited")))
    return S.parse_visited_json(prior.select(document.alias("document")))


@query
def visited_upsert(spark, d):
    saves = I.page_saves(spark, d).select("url", "status", "error", F.timestamp_seconds(F.lit(I.EPOCH) + F.col("seq")).alias("last_visited"))
    return S.upsert_visited(I.prior_visited(spark, d), saves)


# --- checks and reports -----------------------------------------------------


@query
def broken_links(spark, d):
    site = I.site(spark, d)
    return reports.broken_links(links.page_links(site.select("url", "html")), site.select("url", "status"))


@query
def page_report_merge(spark, d):
    return reports.merge_page_saves(I.page_saves(spark, d))


@query
def health_per_url(spark, d):
    return health.health_per_url(I.probes(spark, d))


@query
def health_batch(spark, d):
    return health.health_batch(health.health_per_url(I.probes(spark, d)))


@query
def health_json(spark, d):
    return health.health_json(health.health_per_url(I.probes(spark, d)))


@query
def fetch_batches(spark, d):
    requests = I.site(spark, d, texts=False).select("url", U.host_of(F.col("url")).alias("host"), F.col("page_id").alias("ord"))
    return numbering.request_slots(requests, "host", "ord")


# --- robots -----------------------------------------------------------------


@query
def robots_rules(spark, d):
    return robots.robots_rules(I.robots_txt(spark, d))


@query
def robots_agent_rules(spark, d):
    return robots.agent_rules(robots.robots_rules(I.robots_txt(spark, d))).select("host", "agent", "kind", "rule")


@query
def robots_allowed(spark, d):
    own = I.table(spark, d, "pages").select("url")
    targets = links.page_links(I.site(spark, d).select("url", "html")).select(F.col("link_url").alias("url"))
    urls = own.unionByName(targets).distinct()
    return robots.with_robots(urls, robots.robots_rules(I.robots_txt(spark, d))).select("url", "allowed")


# --- crawl ------------------------------------------------------------------


def _crawl(spark, d, robots_on=False, **params) -> CrawlRun:
    rules = I.robots_txt(spark, d) if robots_on else None
    return crawl(I.snapshot(spark, d), CrawlParams(I.START, ignore_robots=not robots_on, **params), rules)


def crawl_query(spark, d):
    return _crawl(spark, d).reached()


QUERIES["crawl"] = lambda spark, d: crawl_query(configure(spark), d)


@query
def crawl_levels(spark, d):
    return _crawl(spark, d).levels()


@query
def crawl_max_depth(spark, d):
    return _crawl(spark, d, max_depth=3).reached()


@query
def crawl_max_pages(spark, d):
    return _crawl(spark, d, max_pages=40).reached()


@query
def crawl_robots(spark, d):
    run = _crawl(spark, d, robots_on=True)
    return run.pages_report().join(run.admitted.select("url", "depth"), "url").select("url", "depth", "status", "error")


@query
def crawl_stats(spark, d):
    run = crawl(
        I.snapshot(spark, d),
        CrawlParams(I.START, allow_external=True, max_pages=60, max_depth=6),
        I.robots_txt(spark, d),
        I.prior_visited(spark, d),
    )
    return run.stats(I.external_snapshot(spark, d))


def _crawl_sites(spark, d, **params) -> sites.SitesRun:
    pages = I.sites(spark, d)
    starts = pages.select(F.col("start").alias("url")).distinct()
    return sites.crawl_sites(pages.drop("start"), starts, sites.SiteParams(**params), I.robots_txt(spark, d))


@query
def crawl_sites(spark, d):
    return _crawl_sites(spark, d, max_pages=40).report()


@query
def health_document(spark, d):
    """A URL list, a crawl of each, and one document of how they do."""
    return health.health_document(_crawl_sites(spark, d, max_depth=1).health())


@query
def pages_report(spark, d):
    return _crawl(spark, d, robots_on=True, exporting=True).pages_report(_unchanged(spark, d))


@query
def crawl_visited(spark, d):
    return _crawl(spark, d, robots_on=True).visited(F.timestamp_seconds(F.lit(I.EPOCH)))


@query
def crawl_export(spark, d):
    run = _crawl(spark, d, robots_on=True, exporting=True)
    docs = export.last_per_path(export.crawl_exports(run))
    return docs.select("path", "url", "ord", "content_sha256")


@query
def page_errors(spark, d):
    return _crawl(spark, d).page_errors()


@query
def error_report(spark, d):
    return _crawl(spark, d, robots_on=True, allow_external=True).errors(I.external_snapshot(spark, d))


@query
def external_unique(spark, d):
    return _crawl(spark, d, allow_external=True).externals()


@query
def external_check(spark, d):
    run = _crawl(spark, d, robots_on=True, allow_external=True)
    checked = run.external_check(I.external_snapshot(spark, d)).filter("allowed")
    return reports.check_errors(checked.select("source", F.col("url").alias("target"), "status"))


@query
def cache_skip(spark, d):
    pages = I.site(spark, d, texts=False).select("url")
    skipped = cached_urls(I.prior_visited(spark, d), I.START)
    return pages.join(skipped, "url", "left_anti")


@query
def cache_skip_export(spark, d):
    pages = I.site(spark, d, texts=False).select("url")
    skipped = cached_urls(I.prior_visited(spark, d), I.START, I.prior_export_paths(spark, d))
    return pages.join(skipped, "url", "left_anti")


# --- streaming --------------------------------------------------------------


@query
def health_windows(spark, d):
    return health.health_windows(jobs.run_window_counts(I.probes(spark, d), "1 hour", "31 days", "event_id"))


@query
def stream_new_urls(spark, d):
    site = I.site(spark, d).select("url", "html", "page_id")
    found = links.page_links(site.select("url", "html")).join(site.select(F.col("url").alias("page_url"), "page_id"), "page_url")
    targets = found.select(F.col("link_url").alias("url"), "page_url", "page_id")
    return jobs.run_new_urls(targets, "page_id")


@query
def stream_boilerplate(spark, d):
    return jobs.run_boilerplate(I.bp(spark, d))
