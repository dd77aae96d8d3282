"""The training-data operators against brute force, and on the edges of their input."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import common, exact_dedup, licenses, mixing, ngram_join, packing, quality, repeats, sharding, vectors, warc
from weftlink.llm.queries import TOKENIZER

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Names that an operator could use for itself.
CLASH = "_row string, row string, n int, kept string, taken string, label string, score string, shard string"
MORE = ("x", "y", 1, "z", "t", "l", "s", "own")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def documents(spark, texts, ids=None, sources=None):
    rows = []
    for i, text in enumerate(texts):
        doc_id = i if ids is None else ids[i]
        source = f"s{i % 3}" if sources is None else sources[i]
        rows.append((doc_id, text, "en" if i % 2 else None, source, len(text or "") if i % 5 else None, *MORE))
    return spark.createDataFrame(rows, f"{DOC}, {CLASH}").repartition(3)


def edges(spark):
    """Null and empty texts, one very long, repeated rows, a repeated id, null ids, null sources."""
    texts = [None, "", " \t\n", LONG, LONG, "one two", "one  two", "one two", "one two three four five six seven", None, "Für die   Ehre", "same", "same"]
    ids = [0, 1, 2, 3, 4, 5, 6, 6, 8, None, None, 11, 11]
    return documents(spark, texts, ids, [None, "a", "b", "a", None, "a", "a", "c", "c", None, "b", "d", "d"])


def found(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def roots(links, ids):
    own = {i: i for i in ids}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        own[b] = a
    return {i: top(i) for i in ids}


def corpus(seed, n, words, longest=60):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w) if rng.random() < 0.7 else " ".join(w) + " " + rng.choice(texts))
    return texts


WORDS = [f"{a}{b}" for a in ("Ka", "lo", "mi", "nu", "re", "so", "ti") for b in ("ra", "be", "du", "fo", "gi")]


# ---- exact dedup


def test_exact_dedup_on_edges(spark):
    rows = found(exact_dedup.exact_dedup(edges(spark)), "doc_id", "keep_id", "group_size", "kept")
    null_or_empty = [(0, 0, 3, True), (1, 0, 3, False), (None, 0, 3, False)]
    expected = [*null_or_empty, (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 3, True), (6, 5, 3, False), (6, 5, 3, False)]
    expected += [(8, 8, 1, True), (None, None, 1, True), (11, 11, 2, True), (11, 11, 2, False)]
    assert rows == sorted(expected, key=repr)
    sha = {r["text_sha256"] for r in exact_dedup.exact_dedup(edges(spark)).filter("doc_id = 6").collect()}
    assert sha == {hashlib.sha256(b"one two").hexdigest()}


def test_exact_dedup_of_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 3)
    monkeypatch.setattr(exact_dedup, "PARTS", 4)
    texts = ["hot  text"] * 40 + ["hot text"] * 30 + ["two"] * 2 + [f"t{i}" for i in range(20)]
    rows = found(exact_dedup.exact_dedup(documents(spark, texts)), "doc_id", "keep_id", "group_size", "kept")
    assert rows == sorted(
        [(i, 0, 70, i == 0) for i in range(70)] + [(70, 70, 2, True), (71, 70, 2, False)] + [(i, i, 1, True) for i in range(72, 92)], key=repr
    )


def test_exact_dedup_stage_keeps_rows_and_columns(spark):
    docs = edges(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r["_row"] for r in kept.collect()} == {"x"}
    assert found(kept, "doc_id") == sorted([(i,) for i in (0, 2, 3, 5, 8, 11, None)], key=repr)


# ---- sharding


def extendible(rows, limit):
    """The same directory by splitting buckets one at a time."""
    hashed = [(int(hashlib.md5(f"shard:{i}".encode()).hexdigest()[:15], 16), i, n) for i, n in rows]
    out, open_ = {}, [("", hashed)]
    while open_:
        prefix, bucket = open_.pop()
        if sum(b[2] for b in bucket) <= limit or len({b[0] for b in bucket}) == 1:
            out |= {b[1]: prefix for b in bucket}
            continue
        for bit in "01":
            part = [b for b in bucket if format(b[0], "060b")[len(prefix)] == bit]
            if part:
                open_.append((prefix + bit, part))
    return out


def test_shards_split_as_extendible_hashing(spark):
    rng = random.Random(5)
    texts = ["x" * rng.choice((0, 1, 50, 400)) for _ in range(400)] + ["y" * 5000]
    docs = documents(spark, texts)
    got = sharding.assign_shards(docs, 600)
    same = [c for c in docs.columns if c != "shard"]
    assert [c for c in got.columns if c in docs.columns and c != "shard"] == same
    assert found(got, *same) == found(docs, *same)
    expected = extendible([(i, len(t)) for i, t in enumerate(texts)], 600)
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == expected
    for shard, n in Counter(expected.values()).items():
        size = sum(len(texts[i]) for i in expected if expected[i] == shard)
        assert size <= 600 or n == 1


def test_shards_of_equal_ids_and_edges(spark):
    docs = documents(spark, ["x" * 10] * 60 + [None], [7] * 60 + [None])
    sizes = Counter(r["shard"] for r in sharding.assign_shards(docs, 100).filter("doc_id = 7").collect())
    assert sum(sizes.values()) == 60 and max(sizes.values()) <= 10
    assert sharding.assign_shards(edges(spark), 1 << 20).count() == 13
    path = sharding.write_shards(documents(spark, ["a" * 50] * 40), 300)
    assert spark.read.parquet(path).count() == 40


# ---- mixing


def test_targets_and_flow():
    targets = mixing.source_targets({"a": 100, "b": 10, None: 90}, 200)
    # weights a 1, b 2, null 3: b is capped at 30, the rest is shared 1 to 3.
    assert targets == {"a": 42.5, "b": 30, None: 127.5}
    assert mixing.source_targets({"a": 0}, 0) == {"a": 0}
    # A pattern in both sources serves the one whose own words would have to repeat.
    flow = mixing.min_cost_flow([100, 100], [[0], [0, 1]], [100, 100])
    assert flow == [{0: 100}, {1: 100}]
    flow = mixing.min_cost_flow([10, 100], [[0, 1], [1]], [30, 100])
    assert flow == [{0: 30}, {1: 100}]


def test_mix_of_sources(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randint(0, 40) for _ in range(300)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    docs = documents(spark, texts, None, sources)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 300
    size, target, taken = Counter(), {}, Counter()
    by_id = dict(enumerate(sources))
    for r in rows:
        s = by_id[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["size"] == len(texts[r["doc_id"]].split()) and 0 <= r["taken"] <= 3 * r["size"]
    for r in rows:
        assert r["source_size"] == size[by_id[r["doc_id"]]]
    expected = mixing.source_targets(dict(size), sum(size.values()))
    assert {s: float(t) for s, t in expected.items()} == target
    assert all(0 <= target[s] - taken[s] < 1 for s in target)
    assert found(mixing.mix_sources(docs.repartition(7)), "doc_id", "taken") == found(mixing.mix_sources(docs), "doc_id", "taken")
    assert mixing.mix_sources(edges(spark)).count() == 13


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 else ["b", "a", "b"], 10) for i in range(90)] + [(90, [], 5), (91, [None], 7)]
    taken, targets = mixing.mix(spark.createDataFrame(rows, "doc_id long, members array<string>, size long"), "s")
    assert set(targets) == {"a", "b", None} and sum(r["taken"] for r in taken.collect()) == sum(int(t) for _, t in targets.values())


def test_mix_stage_repeats_rows(spark):
    texts = ["w " * 10] * 30 + ["v " * 10] * 5
    docs = documents(spark, texts, None, ["a"] * 30 + ["b"] * 5)
    mixed = mixing.mix_documents(docs)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) == 3
    assert set(found(mixed, *docs.columns)) <= set(found(docs, *docs.columns))
    # a may give 350 - 150, b is capped at three times its 50 words
    assert sum(n for i, n in times.items() if i < 30) == 20 and sum(n for i, n in times.items() if i >= 30) == 15
    assert mixing.mix_documents(edges(spark)).filter("text = ''").count() == 0


def test_mix_stage_shuffles_no_texts(spark):
    rows = [(i % 150, "w " * (i % 7), "en", None if i % 4 == 3 else f"s{i % 4}", i, *MORE) for i in range(300)]
    docs = spark.createDataFrame(rows, f"{DOC}, {CLASH}")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        mixed = mixing.mix_documents(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "hashpartitioning" not in plan
    sized = docs.select("doc_id", F.array("source").alias("members"), mixing.word_count().alias("size"), F.col("n_chars").alias("row"))
    taken, _ = mixing.mix(sized, "mix", whole=True, ties=["row"])
    times = Counter({r["row"]: r["taken"] // r["size"] for r in taken.filter("taken > 0").collect()})
    got = Counter(r["n_chars"] for r in mixed.collect())
    by_id = lambda c: Counter(x for r, n in c.items() for x in [(r % 150, r % 7)] * n)
    assert len(set(times.values())) > 1 and by_id(got) == by_id(times)


# ---- licences


def test_license_rules(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    bsd = licenses.SENTENCES
    two = ". ".join(bsd[i] for i in (20, 21, 22)) + "."
    texts = [
        mit, "some line without end\nReleased under the MIT License.\nmore", two, two + " " + bsd[23] + ".", bsd[23] + ". " + two,
        "Licensed under CC BY-NC 4.0.", "This is licensed under CC BY-NC 4.0 or so.", None, "", "MIT", bsd[4] + ". " + bsd[3] + ".", LONG,
    ]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    got = [rows[i]["licenses"] for i in range(len(texts))]
    assert got == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-NC-4.0", "", "", "", "", "", ""]
    assert rows[0]["sentence_ids"] == "3,4" and rows[7]["n_sentences"] == 0
    assert licenses.scan_licenses(edges(spark)).count() == 13


# ---- packing


def test_word_tokens_equal_the_tokenizer():
    tokens = packing.WordTokens(TOKENIZER)
    rng = random.Random(1)
    texts = ["It's don't we'll", "<|endoftext|> a<|startoftext|>b", "ÀÉ ß cœur éa ΣΑΣ İ K", "a\x1cb a\xa0b c\x85d", "日本ab12 a²b µm ªº x_y-z|q", "ÿĀ×÷"]
    texts += ["".join(rng.choice("aBé'ß|<>. \n12µ×日Σ") for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert tokens(text) == tokens.whole(text)


def test_sequences_are_near_the_bound():
    rng = np.random.default_rng(1)
    for n, mean in ((1000, 6), (20_000, 5), (5_000, 7)):
        lengths = np.exp(rng.normal(mean, 1, n)).astype(int) % 2048 + 1
        counts = np.bincount(lengths, minlength=2049)
        places, sequences = packing.plan_sequences(counts)
        assert sequences <= 1.02 * (counts * np.arange(2049)).sum() / 2048 + 2
        assert np.array_equal(np.bincount(places[:, 0], places[:, 2] - places[:, 1], 2049), counts)


def check_packed(rows, texts):
    tokens = packing.WordTokens(TOKENIZER)
    pieces, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = tokens.whole(texts[r["doc_id"]] or "") + b"\0\0\0\0"
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["start"] == 2048 * r["piece"] and len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["length"]
        assert r["length"] == 2048 or r["start"] + r["length"] == len(ids) // 4
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return pieces, len(sequences)


def test_packing_whole(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 3, 100, 700, 5000)))) for _ in range(120)] + [None, "", LONG]
    rows = packing.pack(documents(spark, texts), TOKENIZER).collect()
    pieces, n = check_packed(rows, texts)
    total, over_half = sum(pieces.values()), sum(2 * r["length"] > 2048 for r in rows)
    assert set(pieces) == set(range(len(texts))) and n <= 1.03 * max(total / 2048, over_half) + 1
    rows = packing.pack(edges(spark), TOKENIZER).collect()
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert max(places.values()) == 1 and len([r for r in rows if r["length"] == 1]) == 4


# ---- repeated strings


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in enumerate(data):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "HASH_SPANS", crowd)
    texts = corpus(7, 40, WORDS, 150) + ["ab" * 300, "a" * 199, "a" * 200, "é" * 150, None, "", "Kara lobe " * 90]
    got = found(repeats.remove_repeats(documents(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(texts, 200)


def test_merged_transforms_find_repeats(monkeypatch):
    rng = random.Random(11)
    for trial in range(12):
        base = bytes(rng.choice(b"ab" if trial % 3 == 0 else b"abcdefgh") for _ in range(900))
        strings = []
        for _ in range(rng.randint(2, 25)):
            a = rng.randint(0, 400)
            s = bytearray(base[a : a + rng.randint(200, 400)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = 90
            strings.append(bytes(s))
        often = np.array([rng.choice((1, 1, 2)) for _ in strings])
        monkeypatch.setattr(repeats, "SHARD_BYTES", rng.choice((300, 1000, 1 << 18)))
        own, offset = repeats.repeated_windows(strings, often)
        seen = Counter()
        for s, n in zip(strings, often):
            for i in range(len(s) - 199):
                seen[s[i : i + 200]] += n
        assert sorted(zip(own.tolist(), offset.tolist())) == [(j, i) for j, s in enumerate(strings) for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1]


def test_repeats_on_edges(spark):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in repeats.remove_repeats(edges(spark), with_text=True).collect()}
    assert rows[(3, len(LONG))]["n_removed"] == len(LONG) and rows[(3, len(LONG))]["kept"] == b""
    assert rows[(5, 7)]["kept"] == b"one two" and repeats.remove_repeats(edges(spark)).count() == 13


# ---- WARC


def test_warc_round_trip(spark):
    html = ["<p>Für</p>", "<p>Für</p>", None, "", "x" * 300_000, "<p>Für</p>", "alone\r\n\r\nWARC/1.1\r\n", "null id"]
    ids = [5, 3, 1, 2, 9, 8, 4, None]
    pages = spark.createDataFrame([(i, f"https://h/{i}", h, "k") for i, h in zip(ids, html)], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.archived_pages(pages).collect()}
    assert len(got) == 8
    for i, h in zip(ids, html):
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {5: 3, 8: 3, 2: 1}


def test_warc_reader_filters_and_skips(spark):
    pages = spark.createDataFrame([(i, f"https://h/{i}", f"page {i % 4}") for i in range(20)], "page_id long, url string, html string")
    path = warc.write_warc(pages.repartition(3))
    all_ = warc.read_warc(spark, path)
    assert all_.count() == 20 and all_.filter("record_type = 'response'").count() == 4
    one = all_.filter("target_uri = 'https://h/2' AND record_type IN ('response', 'resource')").collect()
    assert [bytes(r["payload"]) for r in one] == [b"page 2"]
    assert all_.filter("refers_to_id IS NOT NULL").count() == 16
    heads = warc.read_warc(spark, path, payloads=False).collect()
    assert len(heads) == 20 and all(r["payload"] is None for r in heads)
    warc.write_warc(pages.limit(1), path)
    assert warc.read_warc(spark, path).count() == 21


# ---- near vectors


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((n, (base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])).tolist(), int(rng.integers(0, 2))))
            n += 1
    one = rng.normal(size=16).tolist()
    rows += [(n + i, one, 1) for i in range(30)]
    n += 30
    bad = [None, [], [0.0] * 16, [float("nan"), *one[1:]], [float("inf"), *one[1:]], [None, *one[1:]], one[:8]]
    rows += [(n + i, v, 1) for i, v in enumerate(bad)] + [(n + 20, one, None), (None, one, 1), (n + 21, one[:8], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("many", F.lit("x"))
    able = [(i, np.array(v, np.float32).astype(float), x) for i, v, x in rows if x is not None and v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    links, pairs = Counter(), []
    for a in range(len(able)):
        for b in range(len(able)):
            x, y = able[a], able[b]
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93:
                links[x[0]] += 1
                pairs += [(x[0], y[0])] if None not in (x[0], y[0]) else []
    root = roots(pairs, [r[0] for r in rows if r[0] is not None])
    expected = sorted([(i, links[i], root.get(i), i is not None and root[i] == i) for i, _, _ in rows], key=repr)
    assert found(vectors.near_vectors(frame), "vec_id", "n_links", "component_id", "kept") == expected


def test_vectors_ask_rooms_not_lists(spark, monkeypatch):
    asked, questions = [], vectors.questions

    def counting(*given):
        rows = questions(*given)
        asked.append(rows.count())
        return rows

    monkeypatch.setattr(vectors, "questions", counting)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist(), i % 2) for i in range(1000)]
    assert vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 1000
    # 32 lists of some 16 vectors of a label are one room.
    assert 0 < asked[0] <= 1000


# ---- n-gram join


def jaccard_rows(texts, words, num, den):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    links = []
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links.append((a, b))
    root = roots(links, range(len(sets)))
    return sorted([(i, len(s), root[i]) for i, s in enumerate(sets)], key=repr)


@pytest.mark.parametrize("rule", [ngram_join.Jaccard(4, 85, 100), ngram_join.Jaccard()])
@pytest.mark.parametrize("block", [1024, 4])
def test_ngram_join_by_brute_force(spark, monkeypatch, rule, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    texts = corpus(block, 50, WORDS) + [None, "", "KARA lobe", "kara  LOBE", "Ä ö", "ä ö", "kara", LONG, LONG + " end"]
    base = [rng.choice(WORDS) for _ in range(70)]
    for _ in range(40):  # a large group of near copies
        w = list(base)
        w[rng.randrange(70)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    got = found(ngram_join.join_components(documents(spark, texts), rule), "doc_id", "n_shingles", "component_id")
    assert got == jaccard_rows(texts, rule.words, rule.num, rule.den)


def test_count_tree_keeps_every_pair_that_could_link():
    rng = np.random.default_rng(8)
    rule = ngram_join.Jaccard(4, 85, 100)
    points = rng.poisson(3, (300, ngram_join.GROUPS))
    points[100:200] = np.maximum(0, points[:100] + rng.integers(-1, 2, (100, ngram_join.GROUPS)) * (rng.random((100, ngram_join.GROUPS)) < 0.1))
    sizes = points.sum(1)
    q, p = ngram_join.CountTree(points, sizes).search(points, sizes, rule)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    expected = 185 * bound >= 85 * (sizes[:, None] + sizes[None])
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(expected))))


def test_long_half_alike_documents_are_no_candidates(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(3000)]
    texts = [" ".join([*base[: 375 * i], *(word() for _ in range(375)), *base[375 * (i + 1) :]]) for i in range(8)]
    survivors, searched = [], ngram_join.searched

    def counting(regions, rule):
        pairs = searched(regions, rule)
        survivors.append((regions.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(ngram_join, "searched", counting)
    rule = ngram_join.Jaccard(4, 85, 100)
    assert found(ngram_join.join_components(documents(spark, texts), rule), "doc_id", "n_shingles", "component_id") == jaccard_rows(texts, 4, 85, 100)
    # They meet in regions, and two of them share three quarters; all 28 pairs came through sums of 128 groups.
    assert survivors[0][0] > 8 and survivors[0][1] <= 3


def test_ngram_join_on_edges(spark):
    docs = edges(spark)
    assert ngram_join.join_components(docs).filter("doc_id IS NULL AND component_id IS NULL").count() == 2
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # 4 copies 3; 6 says what 5 says; repeated rows of a kept id stay.
    assert found(kept, "doc_id") == sorted([(i,) for i in (0, 1, 2, 3, 5, 8, None, None, 11, 11)], key=repr)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (302, 302)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(300)]
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == roots([p for p in pairs if p[0] != p[1]], linked)


# ---- quality


def labelled(spark, n=600):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) + (rng.choice(["###", "***", " |"]) if i % 4 == 0 else "") for _ in range(rng.randint(5, 80))) + "." for i in range(n)]
    docs = documents(spark, texts + [None, "", LONG])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n) if i % 3], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_unseen_documents(spark):
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    unseen = [i for i in range(600) if i % 3 == 0]
    right = [rows[i]["keep"] == (i % 4 != 0) for i in unseen]
    assert len(rows) == 603 and sum(right) >= 0.95 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["keep"]}


def test_quality_without_usable_labels(spark):
    docs, labels = labelled(spark, 20)
    none = labels.filter("false").unionByName(spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 7, 0)], labels.schema))
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {1.0}
    assert quality.keep_good(docs, labels.filter("quality = 1")).count() == 23
    assert quality.quality_scores(edges(spark), labels).count() == 13


# ---- empty tables


def test_empty_tables(spark):
    docs = edges(spark).filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    embeddings = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for frame in (
        exact_dedup.exact_dedup(docs), exact_dedup.keep_first(docs), quality.quality_scores(docs, labels), quality.keep_good(docs, labels),
        packing.pack(docs, TOKENIZER), repeats.remove_repeats(docs), warc.archived_pages(pages), sharding.assign_shards(docs, 100),
        vectors.near_vectors(embeddings), mixing.mix_sources(docs), mixing.mix_documents(docs), ngram_join.join_components(docs),
        ngram_join.one_of_each(docs), licenses.scan_licenses(docs),
    ):
        assert frame.count() == 0
