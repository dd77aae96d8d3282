"""Quality scores by co-training two classifiers.

One classifier sees a page's text, the other its metadata (language, source,
length). From a bounded sample of labelled documents each is trained, and round
by round gives the other the documents of an unlabelled pool that it is sure of.
Both are calibrated on labelled documents they weren't trained on, and their
calibrated views combined score every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import lean, text_of
from .hashing import chunks, prefix_sums, substring_hash

#: Labelled documents, and documents of the unlabelled pool, that the fit uses at most.
LABELLED = 8000
POOL = 8000
ROUNDS = 3
#: Pseudo-labels that a view hands over per round, at most this share of the pool for each class.
SHARE = 0.05
#: A view hands over only what it is so sure of, by held-out labels.
SURE = 0.95
THRESHOLD = 0.5

BYTES = 128
KINDS = 9
META = 64
_KIND = np.full(256, 8, np.int64)  # letters beyond ASCII
_KIND[:128] = 7
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,;:!?", b"|*#$%&@~^=+<>[]{}\\/_")):
    _KIND[list(_chars)] = _k


def text_view(texts: pa.Array) -> np.ndarray:
    """Features of each whole text: characters, pairs of character kinds, and how words repeat."""
    out = np.zeros((len(texts), BYTES + KINDS * KINDS + 6))
    for at, data, bounds in chunks(texts):
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(bounds))
        inside = np.ones(len(data), bool)
        inside[bounds[1:] - 1] = False
        length = np.diff(bounds) - 1
        size = np.maximum(length, 1)[:, None]
        chars = np.bincount((owner * BYTES + np.minimum(data, BYTES - 1))[inside], minlength=n * BYTES).reshape(n, BYTES)
        kind = _KIND[data]
        pair = inside[:-1] & inside[1:]
        pairs = np.bincount((owner[:-1] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[pair], minlength=n * KINDS * KINDS).reshape(n, -1)
        blank = (data == 32) | ((data >= 9) & (data <= 13)) | ~inside
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word, whose = substring_hash(prefix_sums(data), start, end), owner[start]
        words = np.bincount(whose, minlength=n)
        order = np.lexsort((word, whose))
        w, o = word[order], whose[order]
        fresh = np.ones(len(w), bool)
        fresh[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        first = np.flatnonzero(fresh)
        times = np.diff(np.concatenate([first, [len(w)]]))
        distinct = np.bincount(o[first], minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, o[first], times)
        follow = np.zeros(n)
        if len(word) > 1:
            same = (word[1:] == word[:-1]) & (whose[1:] == whose[:-1])
            follow = np.bincount(whose[1:][same], minlength=n)
        some = np.maximum(words, 1)
        own = np.stack([np.log1p(length), np.log1p(words), distinct / some, most / some, follow / some, length / some / 10], 1)
        out[at : at + n] = np.hstack([np.sqrt(chars / size), np.sqrt(pairs / size), own])
    return out


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Language and source hashed, length by powers of two; null is a value of its own."""
    out = np.zeros((len(lang), META + 40))
    raw = [f"{k}:{v}".encode() for pair in zip(lang, source) for k, v in zip("ls", pair)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
    slot = substring_hash(prefix_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)) % np.uint64(META)
    out[np.repeat(np.arange(len(lang)), 2), slot.astype(np.int64)] = 1
    for i, n in enumerate(n_chars):
        out[i, META + (39 if n is None or n < 0 else min(38, int(n).bit_length()))] = 1
    return out


@dataclass
class Logistic:
    """Regularised logistic regression on standardised features, by Newton's method."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 8) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            s = p * (1 - p) + 1e-6
            w += np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        return cls(w, mean, scale)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class CoTrained:
    """The two views, their calibration, their combination; or, without both labels, one constant."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic | None
    constant: float

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(views[0])
        if self.combined is None:
            return np.full(n, self.constant), [np.full(n, self.constant)] * 2
        each = [c.logit(m.logit(v)[:, None]) for m, c, v in zip(self.views, self.calibrations, views)]
        return sigmoid(self.combined.logit(np.stack(each, 1))), [sigmoid(e) for e in each]


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """``held`` marks labelled rows kept for calibration; ``pool`` has both views of unlabelled rows."""
    constant = float(y.mean()) if len(y) else 1.0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return CoTrained([], [], None, constant)
    extra = [(np.zeros(0, int), np.zeros(0)) for _ in views]  # pool rows and pseudo-labels of each view
    for turn in range(rounds + 1):
        models, calibrations, sure = [], [], []
        for v in range(2):
            rows, labels = extra[v]
            x = np.vstack([views[v][~held], pool[v][rows]])
            models.append(Logistic.fit(x, np.concatenate([y[~held], labels])))
            calibrations.append(Logistic.fit(models[v].logit(views[v][held])[:, None], y[held]))
            sure.append(sigmoid(calibrations[v].logit(models[v].logit(pool[v])[:, None])) if len(pool[v]) else np.zeros(0))
        if turn == rounds or not len(pool[0]):
            break
        # Each view's surest rows of both classes become training rows of the other.
        most = max(1, int(SHARE * len(pool[0]) * (turn + 1)))
        for v in range(2):
            p = sure[v]
            good = np.argsort(-p, kind="stable")[:most]
            bad = np.argsort(p, kind="stable")[:most]
            good, bad = good[p[good] >= SURE], bad[p[bad] <= 1 - SURE]
            extra[1 - v] = (np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))]))
    both = np.stack([c.logit(m.logit(x[held])[:, None]) for m, c, x in zip(models, calibrations, views)], 1)
    return CoTrained(models, calibrations, Logistic.fit(both, y[held]), constant)


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [text_view(batch.column("text")), meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Co-train on at most LABELLED labelled rows and a POOL of others, both the first in hash order.

    Labels that are null or neither 0 nor 1 don't count; the highest counts
    where an id has several. A fifth of the labelled rows calibrates.
    """
    columns = ["text", "lang", "source", "n_chars"]
    order = F.xxhash64("doc_id", F.lit("sample"))
    told = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", order.alias("_o"))
    marked = stash(rows.join(told, "doc_id", "left"), "labelled")
    first = marked.filter("quality IS NOT NULL").orderBy("_o", "doc_id").limit(LABELLED)
    pool = marked.filter("quality IS NULL").orderBy("_o", "doc_id").limit(POOL)
    picked = stash(first.unionByName(pool).dropDuplicates(["doc_id"]), "picked")
    # At most LABELLED + POOL ids, hence the broadcast.
    sample = docs.select("doc_id", text_of().alias("text"), *columns[1:]).join(F.broadcast(picked), "doc_id")
    widths = BYTES + KINDS * KINDS + 6, META + 40

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.hstack(_views(batch)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * sum(widths)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_o"), batch.column("quality"), flat], names=["o", "quality", "x"])

    got = sample.withColumn("quality", F.col("quality").cast("int")).mapInArrow(features, "o long, quality int, x array<float>").toArrow().sort_by("o")
    x = np.array(got.column("x").combine_chunks().flatten(), np.float64).reshape(got.num_rows, sum(widths))
    y = np.array([-1 if q is None else q for q in got.column("quality").to_pylist()], float)
    views = [x[:, : widths[0]], x[:, widths[0] :]]
    has = y >= 0
    held = np.arange(has.sum()) % 5 == 0
    return co_train([v[has] for v in views], y[has], held, [v[~has] for v in views])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, text_score, meta_score, keep for every row of ``docs``.

    The score is the calibrated chance that quality is 1. Null text is empty
    text, null metadata a value of its own. Without labels of both kinds every
    score is the share of 1 among them (1 without any). Other columns are
    ignored; an empty table gives no rows.
    """
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, (by_text, by_meta) = model.score(_views(batch))
            cols = [batch.column("doc_id"), *(pa.array(np.round(s, 9)) for s in (score, by_text, by_meta)), pa.array(score >= threshold)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "text_score", "meta_score", "keep"])

    rows = docs.select("doc_id", text_of().alias("text"), "lang", "source", "n_chars")
    return rows.mapInArrow(judge, f"doc_id {kind}, score double, text_score double, meta_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, judged as they pass; all columns as they were."""
    model = fit(docs, labels)
    judged = ["text", "lang", "source", "n_chars"]
    # The row travels as one value beside what is judged, so no names can clash.
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"), *judged[1:])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = model.score(_views(batch))
            yield batch.select(["row"]).filter(pa.array(score >= threshold))

    return rows.mapInArrow(lean(sift), rows.select("row").schema).select("row.*")
