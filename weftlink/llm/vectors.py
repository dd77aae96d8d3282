"""Near-duplicate vectors by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centre, with a
short code for what is left in each subspace. Lists of a label share rooms of
about BLOCK vectors. A query goes once to every room with a list that can hold a
vector near enough, takes its distances to what the codes there stand for, and
compares exactly what the distances let through.

A vector within distance r of the query, in the list of centre c, lies on c's
side of the plane between c and the query's own centre; so a list whose plane is
farther than r needs no probe. A code tells how far it is from its vector, so a
distance to it beyond r by more than that rules the vector out. Neither step
loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import components

COSINE = 0.93
#: Vectors that centres and codebooks are trained on, at most.
SAMPLE = 20_000
LISTS = 4096
SUBSPACES = 8
CODES = 256
TRAIN_ROUNDS = 10
#: Vectors that a query meets at once: short lists are put together, longer ones cut.
BLOCK = 2048
QUERIES = 512
SLACK = 1e-5


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None]
    return np.maximum(d, 0)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(TRAIN_ROUNDS):
        own = nearest(x, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray
    parts: list[np.ndarray]  # dimensions of each subspace
    books: list[np.ndarray]

    @classmethod
    def trained(cls, unit: np.ndarray, lists: int) -> Quantiser:
        centres = k_means(unit, min(lists, len(unit)), 1)
        rest = unit - centres[nearest(unit, centres).argmin(1)]
        parts = [p for p in np.array_split(np.arange(unit.shape[1]), SUBSPACES) if len(p)]
        books = [k_means(rest[:, p], min(CODES, len(unit)), 2 + i) for i, p in enumerate(parts)]
        return cls(centres, parts, books)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and distance between the vector and what its code stands for."""
        own = nearest(unit, self.centres).argmin(1)
        rest = unit - self.centres[own]
        codes = np.stack([nearest(rest[:, p], b).argmin(1) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        return own, codes, np.sqrt(((unit - self.decode(own, codes)) ** 2).sum(1))

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        seen = self.centres[lists]
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            seen[:, p] += b[codes[:, i]]
        return seen

    def probes(self, unit: np.ndarray, radius: float) -> np.ndarray:
        """Which lists (columns) can hold a vector within the radius of a row."""
        d = nearest(unit, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(nearest(self.centres[own], self.centres))
        gap = d - d[np.arange(len(d)), own][:, None]
        return gap <= 2 * apart * (radius + SLACK) + SLACK


def unit_rows(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def rooms_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """label, list, low, high: the rooms that hold a list; and label, room, lists: what a room holds."""
    lists = members.groupBy("label", "list").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("label").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    lists = lists.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    room = lambda at: F.floor(at / BLOCK).cast("int")
    lists = stash(lists.select("label", "list", room(F.col("before")).alias("low"), room(F.col("before") + F.col("n") - 1).alias("high")), "list-rooms")
    each = lists.select("label", "list", F.explode(F.sequence("low", "high")).alias("room"))
    return lists, stash(each.groupBy("label", "room").agg(F.collect_list("list").alias("lists")), "rooms")


def questions(classes: DataFrame, rooms: DataFrame, pq: Quantiser, radius: float) -> DataFrame:
    """class, label, v, room: a row for each room where a vector within the radius may be."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                there = part.column("lists")
                n = there.value_lengths().to_numpy()
                able = pq.probes(unit_rows(part), radius)[np.repeat(np.arange(len(n)), n), there.flatten().to_numpy()]
                some = np.logical_or.reduceat(able, np.cumsum(n) - n)  # a room has at least one list
                yield part.select(["class", "label", "v", "room"]).filter(pa.array(some))

    kind = classes.schema["label"].dataType.simpleString()
    met = classes.select("class", "label", "v").join(rooms, "label").select("class", "label", "v", "room", "lists")
    return met.mapInArrow(ask, f"class long, label {kind}, v array<float>, room int")


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """(kind, a, b): kind 0 is b links counted for class a, kind 1 an edge; of classes of one dimension.

    ``classes``: class (long), label, many, v.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    total = classes.count()
    sample = classes.select("v").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).toArrow()
    flat = np.array(sample.column("v").combine_chunks().flatten(), np.float64).reshape(sample.num_rows, -1)
    lists = int(min(LISTS, max(1, round(np.sqrt(total)))))
    pq = Quantiser.trained(flat / np.sqrt((flat * flat).sum(1))[:, None], lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes, off = pq.encode(unit_rows(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("class", "label", "many", "v")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)],
                names=["class", "label", "many", "v", "list", "codes", "off"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    base = f"class long, label {kinds['label']}, many long, v array<float>"
    members = stash(classes.select("class", "label", "many", "v").mapInArrow(place, f"{base}, list int, codes binary, off double"), "inverted-lists")

    lists, rooms = rooms_of(members)
    held = members.join(lists, ["label", "list"]).withColumn("room", F.col("low") + F.pmod(F.xxhash64("class"), F.col("high") - F.col("low") + 1).cast("int"))
    key = ["label", "room"]
    none = lambda t: F.lit(None).cast(t)
    held = held.select(*key, F.lit(0).alias("asks"), "class", "many", "v", "list", "codes", "off")
    asked = questions(classes, rooms, pq, radius)
    asked = asked.select(*key, F.lit(1).alias("asks"), "class", none("long").alias("many"), "v", none("int").alias("list"), none("binary").alias("codes"), none("double").alias("off"))
    rows = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block, group = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*key, "asks")])
            ends = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:]):
                if a == b:
                    continue
                part, this = batch.slice(a, b - a), tuple(keys[:2, a])
                if this != now:
                    now, parts, block = this, [], None
                if keys[2, a] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if block is None:
                    block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    unit = unit_rows(block)
                    names, many, off = (block.column(c).to_numpy() for c in ("class", "many", "off"))
                    codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(names), -1)
                    stand = pq.decode(block.column("list").to_numpy(), codes)
                    group = np.arange(len(names))
                for at in range(0, part.num_rows, QUERIES):
                    some = part.slice(at, QUERIES)
                    query, who = unit_rows(some), some.column("class").to_numpy()
                    near = np.sqrt(nearest(query, stand)) - off[None] <= radius + SLACK
                    q, m = np.nonzero(near & (who[:, None] != names[None]))
                    good = (query[q] * unit[m]).sum(1) >= cosine
                    q, m = q[good], m[good]
                    if not len(q):
                        continue
                    links = np.bincount(q, many[m], len(who)).astype(np.int64)
                    there = np.flatnonzero(links)
                    # Of a query's links one edge for each group of members not yet joined tells all.
                    left, right = [], []
                    for i in there:
                        mine = m[np.searchsorted(q, i) : np.searchsorted(q, i, "right")]
                        groups, first = np.unique(group[mine], return_index=True)
                        left += [who[i]] * len(first)
                        right += list(names[mine[first]])
                        if len(groups) > 1:
                            group[np.isin(group, groups)] = groups[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([0] * len(there) + [1] * len(left), pa.int32()), pa.array([*who[there], *left], pa.int64()), pa.array([*links[there], *right], pa.int64())],
                        names=["kind", "a", "b"],
                    )

    return rows.mapInArrow(meet, "kind int, a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in
    double precision, is at least ``cosine``. Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing; nor do vectors
    of different lengths. Rows with equal label and vector are one class, linked
    among themselves; they are counted, not compared. Null ids count as links of
    others and have a null component. Other columns are ignored; an empty table
    gives no rows.
    """
    v, label = F.col("embedding").cast("array<float>"), F.col("label")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    able = F.coalesce(label.isNotNull() & fine & some, F.lit(False))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), v.alias("v"), able.alias("able"))
    rows = rows.withColumn("h1", F.when(F.col("able"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("able"), F.xxhash64("v", "label")))
    classes = rows.filter("able").groupBy("h1", "h2", "label").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = stash(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sizes = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    found = None
    for d in sorted(sizes):
        part = _links(classes.filter(F.size("v") == d), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        own = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    found = stash(found, "vector-links")
    counts = stash(found.filter("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("n")), "link-counts")
    comp = components(found.filter("kind = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    comp = comp.select(F.col("id").alias("class"), F.col("component_id").alias("root"))
    told = classes.select("class", "h1", "h2", "least", "many").join(counts, "class", "left").join(comp, "class", "left")
    told = stash(told.withColumn("root", F.coalesce("root", "class")), "vector-roots")
    least = stash(told.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    told = stash(told.join(least, "root").select("h1", "h2", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "vector-answers")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept")
    )
