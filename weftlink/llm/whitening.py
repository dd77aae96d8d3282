"""Whitening of embeddings by a block Jacobi-Davidson method.

The covariance is never built: it is known by products with a few vectors at a
time, each a pass over the centred rows by all tasks. The driver keeps vectors
of one dimension's length, as many as the search space has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash

COMPONENTS = 8
#: Fixed values of the contract: an entry c becomes floor(1024 c) + 100000.
SCALE, SHIFT = 1024, 100_000
#: Entries up to this size keep sums and products of their whole numbers exact.
LARGEST = float(1 << 40)
#: Bytes of the rows that are kept, and multiplied, together.
BLOCK_BYTES = 1 << 20
#: Partial sums of more tasks than this are added up by other tasks before the driver sees them.
DIRECT_TASKS = 64
#: A correction equation is solved until its residual has shrunk to this share, or for this many steps.
INNER_SHARE, INNER_STEPS = 0.1, 8
OUTER_STEPS = 200


# ---- the eigenproblem, on the driver, by products only


def orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns made orthonormal, and orthogonal to ``against``; those without anything new are left out."""
    out: list[np.ndarray] = []
    for x in columns.T:
        size = np.linalg.norm(x)
        if not size or not np.isfinite(size):
            continue
        x = x / size
        for _ in range(3):
            for basis in (*against, *([np.stack(out, 1)] if out else [])):
                x = x - basis @ (basis.T @ x)
        rest = np.linalg.norm(x)
        if rest > 1e-8:
            out.append(x / rest)
    return np.stack(out, 1) if out else np.zeros((len(columns), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, share: float = INNER_SHARE, steps: int = INNER_STEPS) -> np.ndarray:
    """Approximate solutions of ``product(x) = right``, column by column, by one product with all of them a step.

    ``product`` maps each column by a symmetric operator of its own.
    """
    norm = np.linalg.norm(right, axis=0)
    safe = lambda v: np.where(v == 0, 1, v)
    x, old = np.zeros_like(right), np.zeros_like(right)
    basis = right / safe(norm)
    beta = np.zeros(right.shape[1])
    cos, sin = np.ones((2, len(beta))), np.zeros((2, len(beta)))  # the last two rotations, newest first
    path = [np.zeros_like(right), np.zeros_like(right)]
    left = norm.copy()
    for _ in range(min(steps, len(right))):
        new = product(basis) - beta * old
        alpha = (basis * new).sum(0)
        new = new - alpha * basis
        after = np.linalg.norm(new, axis=0)
        # The tridiagonal column (beta, alpha, after) under the earlier rotations and a new one.
        above = sin[1] * beta
        middle = cos[1] * beta
        side = cos[0] * middle + sin[0] * alpha
        corner = -sin[0] * middle + cos[0] * alpha
        size = np.hypot(corner, after)
        c, s = np.where(size == 0, 1, corner / safe(size)), after / safe(size)
        direction = np.where(size == 0, 0, (basis - side * path[0] - above * path[1]) / safe(size))
        x = x + direction * (c * left)
        left = -s * left
        path = [direction, path[0]]
        cos, sin = np.stack([c, cos[0]]), np.stack([s, sin[0]])
        old, basis, beta = basis, new / safe(after), after
        if (np.abs(left) <= share * norm).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator.

    Each round takes Ritz pairs of the search space, locks the leading ones whose
    residual is down to rounding, and enlarges the space by the others'
    corrections: solutions of the projected equations (I - QQ')(A - theta)(I -
    QQ') t = -r, with Q the locked and the current vectors. The space restarts
    from its best vectors when it is full.
    """
    wanted = min(wanted, size)
    locked, values = np.zeros((size, 0)), []
    first, most = min(size, 2 * wanted), min(size, 6 * wanted)
    space = orthonormal(np.random.default_rng(seed).standard_normal((size, first)))
    image = product(space)
    for _ in range(OUTER_STEPS):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        residual = image - space * theta
        close = 8 * math.sqrt(size) * np.finfo(float).eps * max([*values[:1], *theta[:1]])
        done = 0
        while done < len(theta) and len(values) + done < wanted and np.linalg.norm(residual[:, done]) <= close:
            done += 1
        locked = np.concatenate([locked, space[:, :done]], 1)
        values += theta[:done].tolist()
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        open_ = wanted - len(values)
        if not open_:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        if space.shape[1] + open_ > most:
            keep = min(space.shape[1], max(open_, first - len(values)))
            space, image = space[:, :keep], image[:, :keep]
        active = np.flatnonzero(np.linalg.norm(residual[:, :open_], axis=0) > close)
        current = np.concatenate([locked, space[:, :open_]], 1)
        away = lambda v: v - current @ (current.T @ v)
        shift = theta[active]
        fresh = minres(lambda v: away(product(v) - v * shift), -away(residual[:, active]))
        fresh = orthonormal(fresh, locked, space)
        if not fresh.shape[1]:
            fresh = orthonormal(np.random.default_rng(len(values)).standard_normal((size, open_)), locked, space)
        if fresh.shape[1]:
            space, image = np.concatenate([space, fresh], 1), np.concatenate([image, product(fresh)], 1)
    raise RuntimeError("the eigenvectors haven't reached double precision")


# ---- the rows, on the executors


@dataclass
class Fit:
    """A whitening: the number of rows, exact sums, leading eigenpairs, trace and the check value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors without null, non-finite or oversized entries, of the most frequent length."""
    rows = embeddings.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fits: Column = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    rows = rows.filter(fits & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(F.size("v") == (common["size"] if common else 0))


def blocks(rows: DataFrame) -> DataFrame:
    """(ids, x): whole-number rows in runs of about ``BLOCK_BYTES``, as bytes of 64-bit integers."""
    kind = rows.schema["vec_id"].dataType

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.floor(SCALE * x).astype(np.int64) + SHIFT
            step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
            cuts = list(range(0, len(x), step))
            ids = pa.ListArray.from_arrays(pa.array([*cuts, len(x)], pa.int32()), batch.column("vec_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[a : a + step].tobytes() for a in cuts], pa.binary())], names=["ids", "x"])

    return stash(rows.mapInArrow(gather, f"ids array<{kind.simpleString()}>, x binary"), "vectors")


def summed(table: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part(rows)``, an array of 8-byte numbers, over all blocks of ``table``; None without blocks.

    Each task adds up its own blocks. The sums of many tasks are added by fewer
    tasks, so that the driver meets about the square root of their number.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("x"):
                found = part(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, size))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    shape = part(np.zeros((1, size), np.int64))
    kind = shape.dtype

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("part"):
                found = np.frombuffer(x.as_buffer(), kind)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = table.select("x").mapInArrow(own, "part binary")
    tasks = table.rdd.getNumPartitions()
    if tasks > DIRECT_TASKS:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(more, "part binary")
    found = [np.frombuffer(r["part"], kind) for r in parts.collect()]
    return sum(found[1:], found[0]).reshape(shape.shape) if found else None


class Centred:
    """Rows minus their mean, in double precision: the mean's whole part is taken off exactly."""

    def __init__(self, n: int, sums: list[int]):
        whole = [s // n for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = np.array([float(Fraction(s - n * w, n)) for s, w in zip(sums, whole)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest


def fit(table: DataFrame, size: int, components: int = COMPONENTS) -> Fit | None:
    """The whitening of all rows of ``table``; None if there are none."""

    def moments(x: np.ndarray) -> np.ndarray:
        # Sums of high and low halves stay within 64 bits.
        return np.concatenate([[len(x)], (x >> 20).sum(0), (x & ((1 << 20) - 1)).sum(0)])

    found = summed(table, size, moments)
    if found is None:
        return None
    n = int(found[0])
    sums = [(int(high) << 20) + int(low) for high, low in zip(found[1 : size + 1], found[size + 1 :])]
    centred = Centred(n, sums)

    def product(vectors: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            rows = centred(x)
            return rows.T @ (rows @ vectors)

        return summed(table, size, of_rows) / n

    trace = float(summed(table, size, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    if not trace:
        return Fit(n, sums, np.zeros(0), np.zeros((size, 0)), trace)
    values, vectors = jacobi_davidson(product, size, components)
    # Directions without variance can't be scaled to one.
    real = values > size * np.finfo(float).eps * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    out = Fit(n, sums, values, vectors, trace)

    def second_moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ (vectors / np.sqrt(values))
        return np.concatenate([w.sum(0)[None], w.T @ w])

    check = summed(table, size, second_moments) / n
    out.identity_error = float(np.abs(check[1:] - np.outer(check[0], check[0]) - np.eye(len(values))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None where 64 bits don't hold them."""
    near = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(1)
    out: list[int | None] = [None] * len(x)
    small = (near < 2.0**62) & (np.abs(x).max(1) < 2.0**62 / n)
    if small.any() and max(map(abs, sums)) < 1 << 62:
        exact = ((n * x[small] - np.array(sums, np.int64)) ** 2).sum(1)
        for k, value in zip(np.flatnonzero(small), exact.tolist()):
            out[k] = value
        small = ~small
    else:
        small = np.ones(len(x), bool)
    for k in np.flatnonzero(small & (near < 2.0**64)):
        value = sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums))
        out[k] = value if value < 1 << 63 else None
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Null vectors, empty ones, and those with a null or non-finite entry, or one
    beyond 2^40, have no rows; of vectors of several lengths only those of the
    most frequent length (the longer on a tie) are fitted and returned. A
    direction without variance is no component: equal vectors give no rows.
    ``deviation`` is null where 64 bits don't hold it. Repeated rows and null ids
    count like others; other columns are ignored; an empty table gives no rows.
    """
    rows = usable(embeddings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    one = rows.select(F.size("v").alias("size")).first()
    table = blocks(rows)
    found = fit(table, one["size"], components) if one else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    size, centred, k = one["size"], Centred(found.n, found.sums), len(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("x")):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, size)
                w = (centred(x) @ found.vectors) / np.sqrt(found.values)
                number = np.repeat(np.arange(len(x)), k)
                columns = [
                    ids.values.take(pa.array(number)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(number), found.n)),
                    pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(number)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(found.values / found.trace, len(x)) if k else np.zeros(0)),
                    pa.array(np.full(len(number), found.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(project, schema)
