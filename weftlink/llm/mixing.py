"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed up by the set of sources they belong to. A flow routes the
tokens of each set to the quotas of its sources; using a set's tokens a second
or third time costs more each time. The flow's totals are then filled with
documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import WORD, renamed, seeded, text_of

REPEATS = 3
#: Cells of the seeded order, over which sums are taken before any row is sorted.
CELL_BITS = 12
TICKET_BITS = 60


def source_targets(sizes: dict[str | None, int], total: int, repeats: int = REPEATS, weights: Sequence[int] = (1, 2, 3)) -> dict[str | None, Fraction]:
    """Shares of ``total`` by weight, none above ``repeats`` times its source's size.

    Sources weigh ``weights`` in turn, by code point, null last. What a capped
    source can't take is shared among the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set[str | None] = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(repeats * sizes[s] for s in capped)
        shares = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if shares[s] > repeats * sizes[s]}
        if not over:
            return {s: shares.get(s, Fraction(repeats * sizes[s])) for s in order}
        capped |= over


def min_cost_flow(words: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words routed from each membership pattern to each of its sources.

    Successive shortest paths. Pattern ``p`` offers its words ``repeats`` times
    at costs 0, 1, 2, ..: a convex price, so first uses come first everywhere.
    """
    n, m = len(words), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, left, cost, index of the reverse arc

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, w in enumerate(words):
        for turn in range(repeats):
            arc(start, p, w, turn)
        for j in members[p]:
            arc(p, n + j, w * repeats, 0)
    for j, quota in enumerate(quotas):
        arc(n + j, end, quota, 0)
    while True:
        cost = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        cost[start], queue, queued = 0, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for i, (b, left, price, _) in enumerate(graph[a]):
                if left > 0 and cost[a] + price < cost[b]:
                    cost[b], via[b] = cost[a] + price, (a, i)
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if via[end] is None:
            break
        path, b = [], end
        while b != start:
            a, i = via[b]
            path.append(graph[a][i])
            b = a
        amount = min(x[1] for x in path)
        for x in path:
            x[1] -= amount
            graph[x[0]][x[3]][1] += amount
    return [{b - n: words[p] * repeats - left for b, left, _, _ in graph[p] if n <= b < n + m and left < words[p] * repeats} for p in range(n)]


def word_count(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def mix(rows: DataFrame, seed: str, repeats: int = REPEATS, whole: bool = False, ties: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """``rows`` (doc_id, members array of sources, size, any others) with ``taken``; and the targets by source.

    ``taken`` counts the words of the document that the mix takes, repeats
    counted. A pattern's flow is that many full passes over its documents and
    the first ones of a seeded order for the rest; the last of these gives only
    some of its words, or with ``whole`` all or none, whichever is nearer.
    Reruns agree: the order hashes the id with the seed, and rows with equal
    ids follow one another by size, then by the columns ``ties``. Members are a set: repeats and order don't
    matter; a null member is a source of its own; no member at all means
    nothing is taken.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct("members")), {"ignoreNullFields": "false"}))
    rows = stash(rows.withColumn("_ticket", seeded("doc_id", seed)), "mix")
    patterns = rows.groupBy("_pattern").agg(F.sum("size").alias("words"), F.first("members").alias("members")).collect()
    patterns = sorted((p for p in patterns if p["members"]), key=lambda p: p["_pattern"])
    sizes: dict[str | None, int] = {}
    for p in patterns:
        for s in set(p["members"]):
            sizes[s] = sizes.get(s, 0) + p["words"]
    total = sum(p["words"] for p in patterns)
    targets = source_targets(sizes, total, repeats) if sizes else {}
    names = list(targets)
    flow = min_cost_flow(
        [p["words"] for p in patterns],
        [sorted({names.index(s) for s in p["members"]}) for p in patterns],
        [int(targets[s]) for s in names],
        repeats,
    )
    plan = [(p["_pattern"], sum(f.values()) // p["words"] if p["words"] else 0, sum(f.values()) % p["words"] if p["words"] else 0) for p, f in zip(patterns, flow)]
    plan = spark.createDataFrame(plan, "_pattern string, _passes long, _rest long")

    cell = F.expr(f"shiftright(_ticket, {TICKET_BITS - CELL_BITS})")
    rows = rows.withColumn("_cell", cell)
    before = Window.partitionBy("_pattern").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("_pattern", "_cell").agg(F.sum("size").alias("_words"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    cells = stash(cells.join(plan, "_pattern"), "mix-cells")
    within = Window.partitionBy("_pattern", "_cell").orderBy("_ticket", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(cells, ["_pattern", "_cell"], "left")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_ahead")))
    if whole:
        extra = F.when(2 * extra >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = F.coalesce(F.col("_passes") * F.col("size") + extra, F.lit(0)).cast("long")
    drop = ["_pattern", "_ticket", "_cell", "_before", "_ahead", "_passes", "_rest"]
    return rows.withColumn("taken", taken).drop(*drop), {s: (sizes[s], float(targets[s])) for s in names}


def mix_sources(docs: DataFrame, seed: str = "mix", repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents of one source each.

    Null text has size 0; a null source is one source, the last. Extra columns
    are ignored, an empty table gives no rows. The number of sources is small
    against the documents: one row for each comes to the driver.
    """
    rows = docs.select("doc_id", F.array(F.col("source").cast("string")).alias("members"), word_count().alias("size"))
    mixed, targets = mix(rows, seed, repeats)
    spark = docs.sparkSession
    named = [(s, s is None, size, target) for s, (size, target) in targets.items()]
    named = spark.createDataFrame(named, "_s string, _none boolean, source_size long, target double")
    source = F.col("members")[0]
    mixed = mixed.withColumn("_s", F.coalesce(source, F.lit(""))).withColumn("_none", source.isNull())
    named = named.withColumn("_s", F.coalesce("_s", F.lit("")))
    return mixed.join(named, ["_s", "_none"]).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix", repeats: int = REPEATS) -> DataFrame:
    """The mix itself: every document as often as it is taken, whole, with its columns.

    A source's documents are taken equally often, but for the first ones of its
    seeded order, which are taken once more. So one row for each source, with
    the last of these, tells of every document what is taken: no text is shuffled.
    """
    docs, names = renamed(docs)
    extra = {"_members": F.array(F.col(names["source"]).cast("string")), "_size": word_count(names["text"])}
    rows = stash(docs.withColumns(extra).withColumn("_row", F.monotonically_increasing_id()), "mix-docs")
    sized = rows.select(F.col(names["doc_id"]).alias("doc_id"), F.col("_members").alias("members"), F.col("_size").alias("size"), "_row")
    taken, _ = mix(sized, seed, repeats, whole=True, ties=["_row"])
    times = F.floor(F.col("taken") / F.col("size"))
    # A document without words can't be taken.
    taken = taken.filter("size > 0").withColumn("_times", times.cast("int")).withColumn("_place", F.struct(seeded("doc_id", seed).alias("ticket"), "doc_id", "size", "_row"))
    sources = taken.groupBy("members", "_times").agg(F.max("_place").alias("_last"))
    sources = sources.groupBy("members").agg(F.min("_times").alias("_least"), F.max(F.struct("_times", "_last")).alias("_most"))
    sources = stash(sources.select(F.col("members")[0].alias("_source"), "_least", F.col("_most._times").alias("_times"), "_most._last"), "mix-sources")
    place = F.struct(seeded(names["doc_id"], seed).alias("ticket"), F.col(names["doc_id"]).alias("doc_id"), F.col("_size").alias("size"), "_row")
    copies = rows.filter("_size > 0").join(F.broadcast(sources), F.col("_members")[0].eqNullSafe(F.col("_source")))
    copies = copies.withColumn("_times", F.when(place <= F.col("_last"), F.col("_times")).otherwise(F.col("_least"))).filter("_times > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*(F.col(own).alias(c) for c, own in names.items()))
