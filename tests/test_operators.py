import random

import pytest
from pyspark.sql import functions as F

from weftlink.operators import boilerplate as B
from weftlink.operators import health, links, lookup, numbering, reports, robots
from weftlink.plans import export
from weftlink.sources import tables as S
from weftlink.streaming.jobs import folder_stream, strip_stream, write_new_urls


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_page_links_keep_first_occurrence_and_type(spark):
    html = '<a href="https:///x"></a><a href="/x"></a><a href="/y"></a><a href="//h/x#f"></a><a href="https://o/"></a>'
    page = spark.createDataFrame([("https://h/start", html)], "url string, html string")
    assert rows(links.page_links(page), "pos", "link_url", "link_type") == [
        (0, "https://h/x", "external"), (1, "https://h/y", "internal"), (2, "https://o/", "external"),
    ]
    assert links.classified_links(page).count() == 5


def test_refresh_target_is_added_once(spark):
    meta = '<meta http-equiv="refresh" content="0; url=page/0">'
    pages = spark.createDataFrame(
        [("https://h/a/b", meta), ("https://h/a/c", meta + '<a href="/page/0">x</a>')], "url string, html string"
    )
    got = rows(links.page_links_with_refresh(pages, "https://h/start"), "page_url", "pos", "link_url", "link_type")
    # Resolved against the start page, not the page itself.
    assert got == [("https://h/a/b", 0, "https://h/page/0", "internal"), ("https://h/a/c", 0, "https://h/page/0", "internal")]


def test_start_url_check(spark):
    urls = spark.createDataFrame([("",), ("ftp://h/",), ("//h/a",), ("h/a",), ("http://h/",), ("a b:c",)], "url string")
    got = {r["url"]: (r["start_url"], r["reason"]) for r in links.start_url_check(urls).collect()}
    assert got == {
        "": ("", "start URL is required"),
        "ftp://h/": ("", 'unsupported scheme "ftp"'),
        "//h/a": ("https://h/a".replace("https:", "https:"), ""),
        "h/a": ("", "start URL must include a host"),
        "http://h/": ("http://h/", ""),
        "a b:c": ("", "invalid start URL"),
    }


ROBOTS = (
    "User-agent: *\nUser-agent: Bot-B\nDisallow: /p\nDisallow:\nAllow: /p/ok*\nUser-agent: weftlink-bot\nDisallow: tmp\nAllow:\n"
    "\nDisallow: /orphan\nUser-agent: *\n# comment only\nDisallow: /late\nUser-agent: *\nSitemap: x\nno colon\nDisallow: /more\n"
)


def test_robots_grouping(spark):
    txt = spark.createDataFrame([("H", 200, ROBOTS), ("gone", 404, ROBOTS)], "host string, status int, body string")
    assert rows(robots.robots_rules(txt), "host", "agent", "kind", "rule") == sorted([
        ("h", "*", "disallow", "/p"), ("h", "*", "allow", "/p/ok"), ("h", "bot-b", "disallow", "/p"),
        ("h", "bot-b", "allow", "/p/ok"), ("h", "weftlink-bot", "disallow", "/tmp"), ("h", "weftlink-bot", "allow", ""),
        ("h", "*", "disallow", "/more"),
    ])


def test_robots_decisions(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /a/b/c\nAllow: /t\nDisallow: /t\n"
    txt = spark.createDataFrame([("h", 200, body), ("own", 200, body + "\nUser-agent: weftlink-bot\nDisallow: /z\n")], "host string, status int, body string")
    urls = ["https://h/a", "https://h/a/b", "https://h/a/b/c", "https://h/t", "https://h", "https://other/a", "https://own/a", "https://own/z"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["allowed"] for r in robots.with_robots(df, robots.robots_rules(txt)).collect()}
    assert [got[u] for u in urls] == [False, True, False, True, True, True, True, False]


def test_salted_join_equals_broadcast_join(spark):
    facts = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    dims = spark.createDataFrame([("hot", 1), ("k7", 2), ("k9", 3)], "k string, v int")
    small = lookup.attach(facts, dims, "k", "id")
    salted = lookup.attach(facts, dims, "k", "id", broadcast_limit=0)
    assert rows(small, "id", "k", F.coalesce("v", F.lit(0))) == rows(salted, "id", "k", F.coalesce("v", F.lit(0)))
    hot = {r["k"] for r in lookup.hot_keys(facts, "k").collect()}
    assert "hot" in hot


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 5).cast("string").alias("k"), (F.col("id") * 13).alias("o"))
    got = rows(numbering.number_rows(df, "k", "o"), "k", "o", "rn")
    seen: dict[str, int] = {}
    for k, _, rn in got:
        seen[k] = seen.get(k, 0) + 1
        assert rn == seen[k]


def test_request_slots(spark):
    df = spark.range(200).select(F.lit("h").alias("host"), F.col("id").alias("ord"))
    got = {r["slot"]: (r["at_second"], r["batch"]) for r in numbering.request_slots(df, "host", "ord", burst=4, per_minute=30).collect()}
    assert got[4] == (0.0, 0) and got[5] == (2.0, 0) and got[34] == (60.0, 1) and len(got) == 200


def fold(pages):
    """Boilerplate by hand, page after page, as a plain loop."""
    state, out = {}, {}
    for host, ord_, text in sorted(pages, key=lambda p: p[1]):
        lines = [line.strip() for line in text.strip().split("\n")]

        def block(ls):
            kept = []
            for line in ls:
                if not line:
                    break
                kept.append(line)
            return kept[:6]

        head, foot = block(lines), block(lines[::-1])[::-1]
        if host not in state:
            state[host] = {"h": head, "f": foot, "hn": 0, "fn": 0}
            out[host, ord_] = text
            continue
        s = state[host]
        cut = lines
        if s["hn"] < 3:
            if head[: len(s["h"])] == s["h"]:
                s["hn"] += 1
            else:
                s["h"], s["hn"] = head, 0
        if s["hn"] >= 3 and head[: len(s["h"])] == s["h"]:
            cut = "\n".join(cut[len(s["h"]):]).strip().split("\n")
        if s["fn"] < 3:
            if foot[-len(s["f"]):] == s["f"]:
                s["fn"] += 1
            else:
                s["f"], s["fn"] = foot, 0
        if s["fn"] >= 3:
            rest_foot = block(cut[::-1])[::-1]
            if rest_foot and rest_foot[-len(s["f"]):] == s["f"]:
                cut = "\n".join(cut[: len(cut) - len(s["f"])]).strip().split("\n")
        stripped = "\n".join(cut).strip()
        out[host, ord_] = stripped or text
    return out


def random_pages(n=400, hosts=3, seed=5):
    rng = random.Random(seed)
    pages = []
    for i in range(n):
        host = f"h{rng.choice([0, 0, 0, 1, 2][:hosts + 2])}"
        head = "\n".join(rng.choice(["A", "A\nB", "A\nB\nC"]) for _ in range(1))
        foot = rng.choice(["Z", "Y\nZ", "X\nY\nZ", "Q"])
        body = f"\n\nbody {i}\n\n" if rng.random() < 0.8 else "\n"
        pages.append((host, i * 3, head + body + foot))
    return pages


def test_boilerplate_equals_plain_fold(spark):
    for seed in (1, 2):
        pages = random_pages(seed=seed)
        df = spark.createDataFrame(pages, "host string, ord bigint, text string")
        # A tiny run length exercises context rows and every fold level.
        rules = B.boilerplate_rules(df, run=4)
        got = {(r["host"], r["ord"]): r["stripped"] for r in B.strip_boilerplate(df, rules).collect()}
        assert got == fold(pages)


def test_boilerplate_needs_three_matches_in_a_row(spark):
    texts = ["H\n\n1", "H\n\n2", "H\n\n3", "H\n\n4", "H\n\n5"]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "host string, ord bigint, text string")
    got = [r["stripped"] for r in B.strip_boilerplate(df, B.boilerplate_rules(df)).orderBy("ord").collect()]
    assert got == ["H\n\n1", "H\n\n2", "H\n\n3", "4", "5"]
    missed = texts[:2] + ["x\n\n3", "H\n\n4", "H\n\n5"]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(missed)], "host string, ord bigint, text string")
    assert B.boilerplate_rules(df).filter(F.col("header_at").isNotNull()).count() == 0


def test_streamed_boilerplate_equals_plain_fold(spark, tmp_path):
    pages = random_pages(n=120, seed=9)
    schema = "host string, ord bigint, text string"
    # Files arrive in page order, one per micro-batch.
    for start in range(0, 120, 45):
        part = spark.createDataFrame(pages[start : start + 45], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = folder_stream(spark, str(tmp_path / "in"), part.schema, files_per_batch=1)
    got = {(r["host"], r["ord"]): r["text"] for r in strip_stream(stream).collect()}
    assert got == fold(pages)


def test_page_report_merge(spark):
    saves = [
        ("u", 1, 200, "", "", "unchanged content"), ("u", 2, 0, "status 404", "", ""), ("u", 3, 404, "", "/m/a", ""),
        ("v", 1, 0, "e1", "", "r1"), ("v", 2, 0, "e2", "", ""),
    ]
    df = spark.createDataFrame(saves, "url string, seq bigint, status int, error string, markdown_path string, skip_reason string")
    got = rows(reports.merge_page_saves(df), "url", "status", "error", "markdown_path", "skip_reason")
    assert got == [("u", 404, "status 404", "/m/a", ""), ("v", 0, "e2", "", "r1")]


def test_health(spark):
    probes = spark.createDataFrame(
        [("a", 200, 5), ("a", 404, 7), ("a", 404, 1), ("b", 200, 3), ("c", None, 2)], "url string, status int, duration_ms bigint"
    )
    per_url = health.health_per_url(probes)
    assert rows(per_url, "url", "status", "duration_ms", "pages_visited", "failures", "errors") == [
        ("a", "fail", 13, 3, 2, "status 404"), ("b", "pass", 3, 1, 0, ""), ("c", "fail", 2, 1, 1, "no response"),
    ]
    assert rows(health.health_batch(per_url), "status", "urls", "failed") == [("fail", 3, 2)]
    text = {r["url"]: r["result"] for r in health.health_json(per_url).collect()}
    assert text["b"] == '{"url":"b","status":"pass","duration_ms":3,"pages_visited":1}'
    assert text["a"].endswith('"errors":[{"message":"status 404"}]}')


def test_url_list_and_visited_cache(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("\n# c\n  a.example/x \nhttp://b.example\n\n")
    assert rows(S.read_url_list(spark, str(tmp_path / "urls.txt")), "url") == [("http://b.example",), ("https://a.example/x",)]
    doc = '{"visited": {"u": {"url": "u", "status": 404, "error": "status 404", "lastVisited": "2024-01-01T00:00:05Z"}, "v": {"url": "v", "status": 200, "lastVisited": "2024-01-02T00:00:00.5Z"}}}'
    (tmp_path / "cache.json").write_text(doc)
    loaded = S.read_visited_document(spark, str(tmp_path / "cache.json"))
    assert rows(loaded, "url", "status", "error") == [("u", 404, "status 404"), ("v", 200, "")]
    newer = spark.sql("select 'u' url, 200 status, '' error, timestamp'2024-02-01 00:00:00' last_visited")
    merged = S.upsert_visited(loaded, newer)
    assert rows(merged, "url", "status") == [("u", 200), ("v", 200)]
    S.write_visited_json(merged, str(tmp_path / "out"))
    assert rows(S.read_visited_json(spark, str(tmp_path / "out")), "url", "status") == [("u", 200), ("v", 200)]
    (tmp_path / "empty.json").write_text("")
    assert S.read_visited_json(spark, str(tmp_path / "empty.json")).count() == 0


def test_visited_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = spark.range(1000, numPartitions=4).select(
        F.concat(F.lit("u"), "id").alias("url"), F.lit(200).alias("status"), F.lit("").alias("error"),
        F.timestamp_micros(F.lit(1_704_067_200_123_456) + F.col("id")).alias("last_visited"),
    )
    S.write_visited_json(first, path)
    columns = ("url", "status", "error", "last_visited")
    assert rows(S.read_visited_json(spark, path), *columns) == rows(first, *columns)
    # The cache is changed and written to its own path, several times.
    same_time = first.filter("url < 'u2'").withColumn("status", F.lit(404))
    changed = same_time.count()
    for _ in range(3):
        S.write_visited_json(S.upsert_visited(S.read_visited_json(spark, path), same_time), path)
    again = S.read_visited_json(spark, path)
    assert again.count() == 1000 and again.filter("status = 404").count() == changed > 0
    with pytest.raises(Exception):
        (tmp_path / "two.json").write_text('{"visited": {}}\n{"visited": {}}')
        S.read_visited_document(spark, str(tmp_path / "two.json")).collect()


def test_exports_write_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "exports")
    doc = lambda name, text: (name, f"---\ncontent_sha256: {text}\n---\n\n{text} at {name}", text)
    table = lambda *docs: spark.createDataFrame(docs, "path string, content string, content_sha256 string")
    assert rows(S.write_exports(table(doc("a", "1"), doc("b", "1")), path), "skip_reason") == [("",), ("",)]
    later = [("a", doc("a", "1")[1] + " later", "1"), doc("c", "3")]
    told = rows(S.write_exports(table(*later), path), "path", "skip_reason")
    assert told == [("a", "unchanged content"), ("c", "")]
    assert rows(S.write_exports(table(doc("b", "2")), path), "path", "skip_reason") == [("b", "")]
    now = {r["path"]: r["content"] for r in S.current_exports(spark, path).collect()}
    assert now == {d[0]: d[1] for d in (doc("a", "1"), doc("b", "2"), doc("c", "3"))}


def test_row_numbers_for_hashed_orders_in_one_group(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("o"))
    got = sorted((r["o"], r["rn"]) for r in numbering.number_rows(df, "k", "o").collect())
    assert [rn for _, rn in got] == list(range(1, 20_001))


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("source", "out", "progress"))
    links = spark.createDataFrame([(f"u{i % 7}", f"p{i}") for i in range(20)], "url string, page_url string")
    links.filter("page_url < 'p15'").write.parquet(source)
    first = write_new_urls(folder_stream(spark, source, links.schema, 1), out, progress).count()
    links.filter("page_url >= 'p15'").write.mode("append").parquet(source)
    again = write_new_urls(folder_stream(spark, source, links.schema, 1), out, progress)
    assert first <= 7 and rows(again, "url") == [(f"u{i}",) for i in range(7)]
    assert spark.read.parquet(out).count() == 7


def test_export_collisions_keep_the_last(spark):
    urls = spark.createDataFrame([("https://h/a", 1), ("https://h/a/", 2), ("https://h/b", 3)], "url string, ord bigint")
    assert rows(export.path_collisions(urls), "path", "pages") == [("h/a.md", 2)]
    from weftlink.functions import urls as U

    docs = urls.withColumn("path", U.export_path(F.col("url")))
    assert rows(export.last_per_path(docs), "url") == [("https://h/a/",), ("https://h/b",)]


def test_canonical_snapshot_keeps_the_last_fetch(spark):
    raw = spark.createDataFrame(
        [
            ("HTTPS://H.example/a#x", 200, 5, 10), ("https://h.example/a", 404, 7, 20), ("https://h.example/a", 500, 7, 20),
            ("https://h.example/b", 200, 1, None), ("mailto:x@h.example", 200, 1, 1), (None, 200, 1, 1),
        ],
        "url string, status int, retrieved_ms int, at int",
    )
    raw = raw.withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
    assert rows(S.canonical_snapshot(raw), "url", "status") == [("https://h.example/a", 500), ("https://h.example/b", 200)]


def test_unread_bodies_are_errors_of_their_own(spark):
    from weftlink.plans.crawl import CrawlParams, crawl

    rows = [("https://h/", 200, '<a href="/a"></a><a href="/b"></a><a href="/c"></a>', 1), ("https://h/a", 200, None, 2), ("https://h/b", 500, None, 3), ("https://h/c", 404, "", 4)]
    result = crawl(spark.createDataFrame(rows, "url string, status int, html string, retrieved_ms long"), CrawlParams("https://h/", ignore_robots=True))
    got = {r["target"]: (r["type"], r["message"], r["status"]) for r in result.errors().collect()}
    assert got == {"https://h/a": ("read", "no body", 0), "https://h/b": ("read", "no body", 0), "https://h/c": ("http", "status 404", 404)}
    report = {r["url"]: (r["status"], r["error"]) for r in result.pages_report().collect()}
    assert report["https://h/a"] == (200, "no body") and report["https://h/c"] == (404, "status 404")


def test_saves_keep_the_last_links_and_time(spark):
    from weftlink.operators.reports import merge_page_saves

    schema = "url string, seq long, status int, error string, links array<string>, retrieved_ms long, markdown_path string, skip_reason string"
    rows = [("u", 1, 200, "", ["a"], 5, "", "s"), ("u", 2, 0, "e", ["b", "c"], 0, "", ""), ("u", 3, 0, "", [], 7, "/m", ""), ("v", 1, 0, "", None, 0, "", "s")]
    got = {r["url"]: tuple(r)[1:] for r in merge_page_saves(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"u": (200, "e", ["b", "c"], 7, "/m", ""), "v": (0, "", [], 0, "", "s")}


def test_health_document_is_one_json_text(spark, tmp_path):
    import json

    from weftlink.operators import health

    rows = [(f"https://h/{i:03}", 404 if i % 50 == 9 else 200, i) for i in range(300)]
    per_url = health.health_per_url(spark.createDataFrame(rows, "url string, status int, duration_ms long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        health.write_health_document(per_url, str(tmp_path / "doc"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "doc").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and document["status"] == "fail" and [r["url"] for r in document["results"]] == [r[0] for r in rows]
    assert document["results"][9] == {"url": "https://h/009", "status": "fail", "duration_ms": 9, "pages_visited": 1, "errors": [{"message": "status 404"}]}
    none = health.health_document(per_url.limit(0)).orderBy("position").collect()
    assert json.loads("".join(r["text"] for r in none)) == {"status": "pass", "results": []}
