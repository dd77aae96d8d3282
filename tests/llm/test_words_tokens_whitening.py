"""Spelling variants, token counts and whitening against brute force, and on the edges of their input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm_operators import LONG, WORDS, documents, edges, found
from weftlink.llm import spelling, token_counts, whitening
from weftlink.llm.queries import PIECES, TOKENIZER

# ---- spelling variants


def counted(rows, every=199, letters=6, least=5):
    n = Counter()
    for doc_id, text in rows:
        key = "" if doc_id is None else str(doc_id)
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_words_of_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Rakete", "rakéte", "RAKETEN", "Ärgers×÷x", "ab", "schachtel", "ÀÉþÿßẞabcdef", "日本wordlike", "x" * 70]) for _ in range(60)) for _ in range(60)]
    texts += [None, "", "éé" * 40, LONG, "a\x00bcdefgh́ij"]
    docs = documents(spark, texts, [*range(len(texts) - 2), None, None])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert dict(found(spelling.word_counts(docs), "word", "n")) == counted(rows)
    assert dict(found(spelling.word_counts(docs, 3, 2, 1), "word", "n")) == counted(rows, 3, 2, 1)


def vocabulary(seed, size, letters, longest):
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        words.add(w)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            words.add(w[:at] + rng.choice([rng.choice(letters), ""]) + w[at + rng.randint(0, 1) :])
    words.discard("")
    return {w: rng.choice([1, 2, 5, 25, 130, 700]) for w in words}


@pytest.mark.parametrize("levels", [64, 5])
def test_variants_by_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(spelling, "LEVELS", levels)
    monkeypatch.setattr(spelling, "SEND_EDGES", 8 * levels)
    n = vocabulary(levels, 400, "abé", 9) | vocabulary(levels + 1, 150, "abcdefghijklmnopqrstuvwxyzÀÿ", 5)
    words = spark.createDataFrame([(w, k, "clash") for w, k in n.items()], "word string, n long, form string")
    assert found(spelling.variants(words), *COLUMNS) == grouped(n)


def test_variants_of_long_words(spark):
    base = "".join(random.Random(5).choice("abcd") for _ in range(90))
    n = {base: 1000, base[1:]: 10, base[:-1]: 20, base[:45] + "x" + base[45:]: 30, base[:64]: 6, base[:63]: 60, base[:65]: 400, "a" * 64: 3, "a" * 65: 15, "a" * 63: 1, "b" * 5000: 1, "b" * 5001: 9}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(words), *COLUMNS) == grouped(n)


def test_chain_of_forms(spark):
    n = {"a" * (6 + i): 5**i for i in range(9)}
    rows = found(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")), *COLUMNS)
    assert {r[2] for r in rows} == {"a" * 14} and rows == grouped(n)


def test_variants_on_edges(spark):
    odd = spark.createDataFrame([(None, 3), ("", 7), ("a", 40)], "word string, n long")
    assert found(spelling.variants(odd), *COLUMNS) == sorted([(None, None, None, 3, 0, None), ("", None, "", 7, 0, None), ("a", None, "a", 40, 0, None)], key=repr)
    assert spelling.spelling_variants(edges(spark)).count() == 0
    assert spelling.spelling_variants(edges(spark).filter("false")).count() == 0


# ---- token counts


def plain_counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(model.encode(t or "")) for t in texts]


def test_counts_by_word_equal_the_library(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB  \n\t▁éß日<s>/0x1 A.,12  ") for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["", " ", "  ", "▁", "a ", " a", "<s></s><unk>", "<0x0A>", LONG, "x" * 20_000, "́é\U0001f600 �"]
    for size in (1, 300, 8 << 20):
        monkeypatch.setattr(token_counts, "CHUNK_BYTES", size)
        assert token_counts.PieceCounts(PIECES)(pa.array(texts)).tolist() == plain_counts(texts)


def test_token_counts_through_the_cache(spark, tmp_path, monkeypatch):
    texts = [None, "", "one two", "one two", "one▁two", LONG, "Für die Ehre", "x " * 5000]
    docs = documents(spark, texts, [0, 1, 2, 2, 4, 5, None, 7]).withColumns({"digest": F.lit("clash"), "given": F.lit(1), "n_bytes": F.lit(2)})
    size = {i: len((t or "").encode()) for i, t in zip([0, 1, 2, 2, 4, 5, None, 7], texts)}
    n = dict(zip([0, 1, 2, 2, 4, 5, None, 7], plain_counts(texts)))
    expected = sorted([(i, size[i], n[i], n[i] > 4096) for i in (0, 1, 2, 2, 4, 5, None, 7)], key=repr)
    cache, columns = str(tmp_path / "cache"), ("doc_id", "n_bytes", "n_tokens", "over_limit")
    folder = f"{cache}/{token_counts.tokenizer_version(PIECES)}"
    assert found(token_counts.count_tokens(docs, PIECES, cache), *columns) == expected
    stored = token_counts.stored_counts(spark, folder)
    assert stored.count() == 5  # empty, "one two" with either mark, and three others
    # A second run encodes what is new, and nothing else.
    wanted = []
    append = token_counts.append_misses
    monkeypatch.setattr(token_counts, "append_misses", lambda t, w, *rest: (wanted.append(w.count()), append(t, w, *rest)))
    assert found(token_counts.count_tokens(docs, PIECES, cache), *columns) == expected and wanted == []
    more = docs.unionByName(documents(spark, ["new text"], [9]).withColumns({"digest": F.lit("clash"), "given": F.lit(1), "n_bytes": F.lit(2)}))
    assert token_counts.count_tokens(more, PIECES, cache).count() == 9 and wanted == [1]
    # Another version has counts of its own; appends can be folded, and may have rows twice.
    assert token_counts.count_tokens(docs, TOKENIZER, cache).filter("doc_id = 2 AND n_tokens = 2").count() == 2
    token_counts.stored_counts(spark, folder).write.parquet(f"{folder}/again")
    token_counts.compact(spark, cache, PIECES)
    assert len(token_counts.child_names(spark, folder)) == 1 and token_counts.stored_counts(spark, folder).count() == 6
    assert found(token_counts.count_tokens(docs, PIECES, cache), *columns) == expected


def test_token_counts_when_digests_are_many(spark, monkeypatch):
    texts = [f"text {i % 40} " * (i % 7) for i in range(300)]
    few = found(token_counts.count_tokens(documents(spark, texts), PIECES), "doc_id", "n_tokens")
    monkeypatch.setattr(token_counts, "SEND_BYTES", 0)
    assert found(token_counts.count_tokens(documents(spark, texts), PIECES), "doc_id", "n_tokens") == few == sorted(enumerate(plain_counts(texts)), key=repr)


def test_token_counts_on_edges(spark):
    rows = token_counts.count_tokens(edges(spark), PIECES, limit=3)
    long = sum(n > 3 for n in plain_counts([r["text"] for r in edges(spark).collect()]))
    assert rows.count() == 13 and rows.filter("over_limit").count() == long > 0
    assert token_counts.count_tokens(edges(spark).filter("false"), PIECES).count() == 0


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string").repartition(3)


def check_whitening(frame, rows, components):
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    c = (x - sums[0]).astype(float)
    c = c - c.mean(0)
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = ((n * x - sums) ** 2).sum(1)
    got = {}
    for r in frame.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == {i for i, _ in rows} and all(set(v) == set(range(1, components + 1)) for v in got.values())
    expected = c @ basis / np.sqrt(values)
    for k in range(components):
        w = np.array([got[i][k + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(w - expected[:, k]).max(), np.abs(w + expected[:, k]).max()) < 1e-8
    one = got[rows[0][0]]
    assert all(abs(one[k + 1]["explained"] / (values[k] / (c**2).sum() * n) - 1) < 1e-9 for k in range(components))
    assert [got[i][1]["deviation"] for i, _ in rows] == deviation.tolist() and one[1]["n"] == n
    assert {r["identity_error"] for v in got.values() for r in v.values()} == {one[1]["identity_error"]} and one[1]["identity_error"] < 1e-9


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_whitening_by_dense_eigenvectors(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    monkeypatch.setattr(whitening, "DIRECT_TASKS", 2 if block == 200 else 64)
    rng = np.random.default_rng(1)
    rows = [(i, (v * 2).tolist()) for i, v in enumerate(rng.normal(size=(300, 20)) * np.linspace(0.2, 1, 20))]
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, []), (905, [1.0]), (906, [1e30] * 20)]
    check_whitening(whitening.whiten(vectors(spark, rows + bad)), rows, 8)


def test_whitening_of_few_dimensions_and_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [3.0, -1.0]), (3, [-2.0, 0.5]), (4, [1.0, 1.0])]
    check_whitening(whitening.whiten(vectors(spark, rows)), rows, 2)
    # Four rows span three directions; equal rows, and one row, none.
    rng = np.random.default_rng(2)
    assert whitening.whiten(vectors(spark, [(i, rng.normal(size=12).tolist()) for i in range(4)])).count() == 4 * 3
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [5.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    twice = whitening.whiten(vectors(spark, [(None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]))
    assert Counter(r["vec_id"] for r in twice.collect()) == {None: 1, 7: 2}


def test_eigenpairs_of_hard_spectra():
    rng = np.random.default_rng(4)
    spectra = ([5, 5, 5, 1, 1, 1] + [0.1] * 94, np.linspace(1, 0.9, 300), 0.9 ** np.arange(300), [3, 2, 1] + [0] * 97, [1, 2, 3], [1], 10.0 ** -np.arange(30))
    for values in spectra:
        values = np.sort(np.array(values, float))[::-1]
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        matrix = q * values @ q.T
        got, vectors_ = whitening.jacobi_davidson(lambda u, m=matrix: m @ u, len(values), 8)
        assert np.abs(got - values[:8]).max() < 1e-13 * values[0] and np.abs(vectors_.T @ vectors_ - np.eye(len(got))).max() < 1e-13
        assert np.linalg.norm(matrix @ vectors_ - vectors_ * got, axis=0).max() < 1e-12 * values[0]


def test_exact_deviations():
    x = np.array([[1 << 39, 3], [5, -(1 << 39)], [7, 9]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 3, sums) == [v if v < 1 << 63 else None for v in exact]
    small = np.array([[1, 2], [3, 5]], np.int64)
    assert whitening.deviations(small, 2, [4, 7]) == [13, 13]
