"""Crawls of many sites against a plain loop per start; keys and plans of long crawls."""

import random

import pytest
from pyspark.sql import functions as F

from test_crawl import HOST, level_site, plain_crawl, random_site, run, table
from weftlink.plans import sites
from weftlink.plans.crawl import CrawlParams, crawl


def snapshot(spark, by_host):
    rows = [(host + path, 200, html) for host, site in by_host.items() for path, html in site.items()]
    return spark.createDataFrame(rows, "url string, status int, html string")


def starts(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def hosts(n):
    return [f"https://h{k}.test" for k in range(n)]


@pytest.mark.parametrize("max_pages,max_depth", [(0, -1), (7, -1), (1, -1), (0, 2), (25, 3)])
def test_each_site_equals_a_plain_loop(spark, max_pages, max_depth):
    by_host = {h: random_site(k) for k, h in enumerate(hosts(4))}
    cached = {h: {p for i, p in enumerate(site) if i % 5 == 3} for h, site in by_host.items()}
    visited = starts(spark, *(h + p for h in by_host for p in cached[h]))
    urls = [h + "/start" for h in by_host]
    result = sites.crawl_sites(snapshot(spark, by_host), starts(spark, *urls), sites.SiteParams(max_pages, max_depth), visited=visited)
    got = {}
    for r in result.admitted.collect():
        host = r["start"].removesuffix("/start")
        got.setdefault(host, {})[r["url"].removeprefix(host)] = r["depth"]
    assert got == {h: plain_crawl(site, max_pages, max_depth, cached[h])[0] for h, site in by_host.items()}
    result.close()


def test_places_are_the_order_of_arrival(spark):
    by_host = {h: random_site(k + 10) for k, h in enumerate(hosts(2))}
    result = sites.crawl_sites(snapshot(spark, by_host), starts(spark, *(h + "/start" for h in by_host)))
    for host, site in by_host.items():
        order = list(plain_crawl(site, 0, -1, set())[0])
        rows = result.admitted.filter(F.col("start") == host + "/start").orderBy("depth", "place").collect()
        assert [r["url"].removeprefix(host) for r in rows] == order
        assert all(r["place"] == 1 for r in rows if r["depth"] == 0)


def test_starts_of_all_kinds(spark):
    by_host = {h: {"/a": '<a href="/b">b</a>', "/b": '<a href="/a">a</a>'} for h in hosts(2)}
    given = starts(spark, "https://h0.test/a", "HTTPS://H0.test/./a#x", "https://h0.test/b", "h1.test/a", "https://none.test/", "ftp://h0.test/a", "", None, "https://h0.test/x.pdf")
    result = sites.crawl_sites(snapshot(spark, by_host), given)
    stats = {r["start"]: (r["pages"], r["broken"], r["levels"], r["capped"]) for r in result.stats().collect()}
    assert stats == {f"https://{u}": (2, 0, 2, False) for u in ("h0.test/a", "h0.test/b", "h1.test/a")} | {"https://none.test/": (1, 1, 1, False)}
    refused = {r["url"]: r["reason"] for r in result.refused.collect()}
    assert refused == {"ftp://h0.test/a": 'unsupported scheme "ftp"', "": "start URL is required", "https://h0.test/x.pdf": "extension not allowed"}
    errors = {r["url"]: r["error"] for r in result.report().collect()}
    assert errors == {"https://h0.test/a": "", "https://h0.test/b": "", "https://h1.test/a": "", "https://h1.test/b": "", "https://none.test/": "no response"}
    assert sites.crawl_sites(snapshot(spark, by_host), given.limit(0)).admitted.count() == 0


def test_health_of_a_url_list(spark):
    by_host = {"https://h0.test": {"/": '<a href="/x">x</a>', "/x": ""}, "https://h1.test": {"/": '<a href="/gone">y</a>'}}
    pages = snapshot(spark, by_host).withColumn("retrieved_ms", F.lit(4).cast("long"))
    run_ = sites.crawl_sites(pages, starts(spark, "h0.test", "h1.test", "ftp://x", "https://none.test/"))
    got = {r["url"]: tuple(r)[1:] for r in run_.health().collect()}
    assert got == {
        "https://h0.test/": ("pass", 8, 2, 0, ""),
        "https://h1.test/": ("fail", 4, 2, 1, "no response"),
        "https://none.test/": ("fail", 0, 1, 1, "no response"),
        "ftp://x": ("fail", 0, 0, 1, 'unsupported scheme "ftp"'),
    }


def test_robots_of_each_site(spark):
    by_host = {h: {"/start": '<a href="/x">x</a><a href="/y">y</a>', "/x": '<a href="/z">z</a>', "/y": ""} for h in hosts(2)}
    robots = spark.createDataFrame([("h0.test", 200, "User-agent: *\nDisallow: /x\n")], "host string, status int, body string")
    result = sites.crawl_sites(snapshot(spark, by_host), starts(spark, *(h + "/start" for h in by_host)), robots_txt=robots)
    report = {(r["start"], r["url"]): r["error"] for r in result.report().collect()}
    assert {u: e for (s, u), e in report.items() if "h0" in s} == {"https://h0.test/start": "", "https://h0.test/x": "blocked by robots.txt", "https://h0.test/y": ""}
    assert {u: e for (s, u), e in report.items() if "h1" in s} == {f"https://h1.test/{p}": e for p, e in (("start", ""), ("x", ""), ("y", ""), ("z", "no response"))}


def test_sites_leave_when_they_are_done(spark, monkeypatch):
    """A level holds only sites that found something new."""
    sizes, admit = [], sites._admit

    def counted(found, *rest):
        sizes.append(found.select("start").distinct().count())
        return admit(found, *rest)

    monkeypatch.setattr(sites, "_admit", counted)
    by_host = {h: level_site(k) for k, h in enumerate(hosts(4))}
    result = sites.crawl_sites(snapshot(spark, by_host), starts(spark, *(h + "/start" for h in by_host)))
    # The two shortest end with a page that isn't there, the others one and two levels later.
    assert sizes == [4, 4, 2, 1, 0]
    assert sorted(r["levels"] for r in result.stats().collect()) == [2, 2, 3, 4]


def test_a_level_shuffles_neither_graph_nor_known_urls(spark):
    by_host = {h: random_site(k) for k, h in enumerate(hosts(2))}
    result = sites.crawl_sites(snapshot(spark, by_host), starts(spark, *(h + "/start" for h in by_host)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        going = result.admitted.filter("allowed AND depth = 1")
        plan = sites._found(result.links.read(), going, result.known.read(), None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The links found, by their target; the frontier is read from the bucketed table here.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2


def test_keys_stay_short_in_a_long_chain(spark):
    result = run(spark, level_site(40))
    row = result.admitted.agg(F.max(F.length("key")).alias("key"), F.max(F.length("base")).alias("base"), F.count("*").alias("n")).first()
    assert row["n"] == 41 and row["key"] <= 16 + 8 * 8 and row["base"] <= 16 + 8 * 7


def test_order_and_caps_hold_across_rankings(spark):
    """Wide levels beyond the first ranking: the cap cuts in the order of arrival."""
    rng = random.Random(4)
    site = {"/start": "".join(f'<a href="/l0/{i}">x</a>' for i in range(6))}
    for depth in range(11):
        for i in range(6):
            below = rng.sample(range(6), 4)
            site[f"/l{depth}/{i}"] = "".join(f'<a href="/l{depth + 1}/{j}">x</a>' for j in below)
    for cap in (0, 52, 57, 63):
        result = crawl(table(spark, site), CrawlParams(HOST + "/start", ignore_robots=True, max_pages=cap))
        order, stats, _ = plain_crawl(site, cap, -1, set())
        assert {r["url"].removeprefix(HOST): r["depth"] for r in result.admitted.collect()} == order
        if cap:
            assert result.stats().first()["skipped_by_limit"] == stats["limit"]
