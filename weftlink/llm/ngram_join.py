"""Similarity join on word-shingle sets by count vectors in R-trees.

Shingles are hashed into groups; a document is the point of its group counts.
What two documents share is at most the sum of the smaller counts, and the same
holds for a tree node with its largest counts, so a search leaves out whole
subtrees. Trees hold sums of neighbouring groups; what they let through meets the
same bound by the groups themselves, whose small counts say more about long
documents. Surviving pairs are verified on the sets themselves.

Trees are per region: two documents as similar as asked share one of their
first shingles in any common order, so each such shingle has a tree of the
documents that begin with it. The order starts with the rarest groups, which
keeps passages that many documents share out of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import components, lean, text_of
from .hashing import chunks, mix, shingles

GROUPS = 512
#: Sums of groups that trees hold.
TREE_GROUPS = 128
#: Groups whose sizes over all documents give the order of shingles.
ORDER_BITS = 16
FANOUT = 16
#: Documents of one region searched together; larger regions go by pairs of blocks.
BLOCK = 1024
#: So many ids of candidates are sent to all executors; more are shuffled instead.
SENT_IDS = 1 << 20
#: (query, node) pairs looked at together.
FRONT = 1 << 16


@dataclass(frozen=True)
class Jaccard:
    """|A & B| * den >= num * |A | B| on shingles of ``words`` words."""

    words: int = 5
    num: int = 4
    den: int = 5

    def least(self, n: np.ndarray) -> np.ndarray:
        """The smallest overlap a set of n shingles needs with any partner."""
        return -(-self.num * n // self.den)

    def need(self, a, b):
        """The overlap that sets of a and b shingles need."""
        return -(-self.num * (a + b) // (self.num + self.den))


class CountTree:
    """A bulk-loaded R-tree over count vectors."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._tiles(points, np.arange(len(points)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        top, low, high = self.points, self.sizes, self.sizes
        self.levels = []
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def _tiles(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows so that neighbours are near: halved along the widest count, again and again."""
        if len(rows) <= FANOUT:
            return rows
        spread = points[rows].max(0) - points[rows].min(0)
        axis = int(np.argmax(spread))
        half = -(-len(rows) // (2 * FANOUT)) * FANOUT
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        return np.concatenate([self._tiles(points, rows[:half]), self._tiles(points, rows[half:])])

    def search(self, query: np.ndarray, size: np.ndarray, rule: Jaccard) -> tuple[np.ndarray, np.ndarray]:
        """(query row, point row) of all pairs that the bound lets through."""

        def passing(q, node, top, low, high):
            fits = (rule.den * high[node] >= rule.num * size[q]) & (rule.num * low[node] <= rule.den * size[q])
            q, node = q[fits], node[fits]
            parts = []
            for at in range(0, len(q), FRONT):
                a, b = q[at : at + FRONT], node[at : at + FRONT]
                other = np.maximum(low[b], rule.least(size[a]))
                parts.append(np.minimum(query[a], top[b]).sum(1, dtype=np.int64) >= rule.need(size[a], other))
            keep = np.concatenate(parts) if parts else np.zeros(0, bool)
            return q[keep], node[keep]

        found = []
        for start in range(0, len(query), 256):
            q = np.arange(start, min(start + 256, len(query)))
            node = np.zeros(len(q), np.int64)
            for level in range(len(self.levels) - 1, -2, -1):
                if level >= 0:
                    q, node = passing(q, node, *self.levels[level])
                    below = len(self.levels[level - 1][0]) if level else len(self.points)
                    q = np.repeat(q, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, node = q[node < below], node[node < below]
                else:
                    q, node = passing(q, node, self.points, self.sizes, self.sizes)
            found.append((q, self.order[node]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_counts(counts: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Jaccard) -> np.ndarray:
    """Which of the pairs of rows (a, b) the bound by all groups lets through."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), FRONT // 4):
        x, y = a[at : at + FRONT // 4], b[at : at + FRONT // 4]
        keep[at : at + FRONT // 4] = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) >= rule.need(size[x], size[y])
    return keep


def group_sizes(texts: DataFrame, rule: Jaccard) -> np.ndarray:
    """Shingles of all documents in each of 2^ORDER_BITS groups; so many counts and no more reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for _, data, bounds in chunks(batch.column("text")):
                found, _ = shingles(data, bounds, rule.words)
                sums += np.bincount((found >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(sums))
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], names=["g", "n"])

    rows = texts.select("text").mapInArrow(lean(count), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros(1 << ORDER_BITS, np.int64)
    sizes[rows["g"].to_numpy()] = rows["n"].to_numpy()
    return sizes


def signatures(texts: DataFrame, sizes: np.ndarray, rule: Jaccard) -> DataFrame:
    """doc_id, n, two hashes of the set, its first shingles, its counts by group."""
    order = np.empty(len(sizes), np.uint64)
    order[np.argsort(sizes, kind="stable")] = np.arange(len(sizes), dtype=np.uint64)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in chunks(batch.column("text")):
                found, cuts = shingles(data, bounds, rule.words)
                n = np.diff(cuts)
                owner = np.repeat(np.arange(len(n)), n)
                group = (found >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)
                counts = np.bincount(owner * GROUPS + group, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
                # A byte for each count where that is enough, else four; most are small and compress well.
                packed = [zlib.compress(c.astype("u1" if c.max() < 256 else "<u4").tobytes(), 1) for c in counts]
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(found) + 1, np.uint64)
                    np.cumsum(mix(found * np.uint64(2 * salt + 1) + np.uint64(salt)), out=total[1:])
                    sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
                # A shingle's place in the order: its group's rank, then itself.
                low = np.uint64((1 << (64 - ORDER_BITS)) - 1)
                key = (order[(found >> np.uint64(64 - ORDER_BITS)).astype(np.int64)] << np.uint64(64 - ORDER_BITS)) | (found & low)
                first = np.where(n > 0, n - rule.least(n) + 1, 0)
                heads = []
                for i in np.flatnonzero(n):
                    part = np.sort(key[cuts[i] : cuts[i + 1]])
                    heads.append(part[: first[i]])
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(first, out=ends[1:])
                flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(n)), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(packed, pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "head", "counts"],
                )

    return texts.mapInArrow(lean(sign), f"doc_id {kind}, n long, s1 long, s2 long, head array<long>, counts binary")


def verified(pairs: DataFrame, texts: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, from the whole texts.

    Texts travel, compressed, not sets: hashes take more bytes and don't compress.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [zlib.compress(t.as_py().encode(), 1) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(small, pa.binary())], names=["doc_id", "text"])

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, bounds in chunks(pa.array([zlib.decompress(t.as_py()) for t in column], pa.large_binary())):
            found, cuts = shingles(data, bounds, rule.words)
            out += [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keep = []
                for x, y in zip(sets(part.column("ta")), sets(part.column("tb"))):
                    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(same > 0 and rule.den * same >= rule.num * (len(x) + len(y) - same))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).groupBy("doc_id").agg(F.count("*").alias("pairs"))
    # Of the texts only candidates are to be shuffled: Spark's own Bloom filter
    # sees to it, which it builds on a side that is filtered by a comparison.
    ids = stash(ids, "candidates").filter("pairs > 0").select("doc_id")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts.sparkSession.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    some = stash(texts.join(ids, "doc_id", "left_semi").mapInArrow(lean(press), f"doc_id {kind}, text binary"), "candidate-texts")
    left = some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(lean(compare), f"a {kind}, b {kind}").distinct()


def searched(regions: DataFrame, rule: Jaccard) -> DataFrame:
    """Pairs (a, b) of different components that the trees of the regions let through.

    ``regions``: key, c1, c2, rep, n, comp, counts, side. Rows of side 0 are
    searched for in the tree of side 1, or in one tree where c1 = c2.
    """
    kind = regions.schema["rep"].dataType.simpleString()
    names = ["key", "c1", "c2"]

    def pairs_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        comp = rows.column("comp").to_numpy()
        if len(comp) < 2 or (comp == comp[0]).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = rows.column("n").to_numpy()
        packed = [zlib.decompress(p) for p in rows.column("counts").to_pylist()]
        if all(len(p) == GROUPS for p in packed):
            counts = np.frombuffer(b"".join(packed), "u1").reshape(-1, GROUPS)
        else:
            counts = np.stack([np.frombuffer(p, "u1" if len(p) == GROUPS else "<u4").astype("<u4") for p in packed])
        points = counts.reshape(len(n), TREE_GROUPS, -1).sum(2, dtype="<u4")
        if points.max() < 256:
            points = points.astype("u1")
        side = rows.column("side").to_numpy()
        if rows.column("c1")[0].as_py() == rows.column("c2")[0].as_py():
            left = right = np.arange(len(n))
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return left[:0], left[:0]
        q, p = CountTree(points[right], n[right]).search(points[left], n[left], rule)
        q, p = left[q], right[p]
        keep = comp[q] != comp[p]
        if left is right:
            keep &= q < p
        q, p = q[keep], p[keep]
        keep = near_counts(counts, n, q, p, rule)
        return q[keep], p[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            q, p = pairs_of(rows)
            rep = rows.column("rep").combine_chunks()
            return pa.RecordBatch.from_arrays([rep.take(pa.array(q)), rep.take(pa.array(p))], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and any(held[-1].column(c)[0] != batch.column(c)[a] for c in names):
                    yield flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(pa.Table.from_batches(held))

    sorted_rows = regions.repartition(*names).sortWithinPartitions(*names)
    found = sorted_rows.mapInArrow(lean(run), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_components(docs: DataFrame, rule: Jaccard = Jaccard()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) per row.

    Rows with equal sets are one point, so copies cost no pairs. Empty sets
    link with nothing. Rows that share a doc_id are one document to the links;
    a null doc_id links with nothing and has a null component. Null text is
    empty, other columns are ignored, an empty table gives no rows.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    sets = stash(signatures(texts, group_sizes(texts, rule), rule).withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = sets.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "row")).alias("first")
    classes = stash(some.groupBy("n", "s1", "s2").agg(first).select("n", "s1", "s2", "first.*"), "set-classes")
    points = sets.join(classes.select("row"), "row", "left_semi")
    points = stash(points.select(F.col("doc_id").alias("rep"), "n", "head", "counts"), "points")

    entries = points.select("rep", "n", F.explode("head").alias("key"))
    shared = stash(entries.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "regions")
    live = stash(entries.join(shared, "key"), "entries")

    # First, each document of a region with the one that shares most regions with
    # others, where they meet in a quarter of their regions: most groups are one
    # component after it. Whatever this leaves out, the search below finds.
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    live = live.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    central = stash(live.groupBy("rep").agg(F.sum("many").alias("score")), "scores")
    best = Window.partitionBy("key", "block").orderBy(F.desc("score"), "rep")
    pairs = live.join(central, "rep").select(F.first("rep").over(best).alias("x"), F.first("n").over(best).alias("m"), F.col("rep").alias("y"), "n")
    least, most = F.least("m", "n"), F.greatest("m", "n")
    pairs = pairs.filter((rule.den * least >= rule.num * most) & (F.col("x") != F.col("y")))
    head = least - F.ceil(rule.num * least / rule.den) + 1
    pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("met"), F.max(head).alias("of"))
    pairs = stash(pairs.filter("4 * met >= of").select("a", "b"), "central-pairs")
    links = stash(verified(pairs, texts, rule), "links")
    comp = stash(components(links), "components")

    # Then a search for every pair of different components.
    placed = live.join(comp.select(F.col("id").alias("rep"), F.col("component_id").alias("c")), "rep", "left")
    placed = stash(placed.withColumn("comp", F.coalesce("c", "rep")).drop("c"), "placed")
    # Near copies share many regions of the same members; one of each is enough.
    member = lambda salt: F.try_sum(F.shiftright(F.xxhash64("rep", "n", F.lit(salt)), 24))
    mixed = placed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"),
        F.coalesce(member(1), "key").alias("m1"), F.coalesce(member(2), "key").alias("m2"),
    ).filter("low < high")
    mixed = mixed.groupBy("size", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    open_rows = placed.join(stash(mixed, "open-regions"), "key", "left_semi")
    open_rows = open_rows.join(points.select("rep", "n", "counts"), ["rep", "n"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = open_rows.select("key", "rep", "n", "comp", "counts", "block", other)
    cells = cells.select(
        "key", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), "rep", "n", "comp", "counts",
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    more = stash(searched(cells, rule).join(pairs, ["a", "b"], "left_anti"), "survivors")
    links = links.unionByName(verified(more, texts, rule))
    comp = stash(components(links), "components")

    found = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    found = stash(found.select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id")), "class-components")
    rows = sets.select("doc_id", "n", "s1", "s2").join(found, ["n", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, rule: Jaccard = Jaccard()) -> DataFrame:
    """``docs`` without those that have a linked document of a smaller id in their component."""
    again = join_components(docs, rule).filter("doc_id <> component_id").select("doc_id")
    return docs.join(stash(again, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
