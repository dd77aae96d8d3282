"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

1. Every window of the asked length is assigned the smallest hash among its
   short grams. Equal windows have equal ones, so runs of windows of one such
   hash ("spans") can be told apart hash by hash: spans whose hash occurs once
   hold no repeat, and spans equal as a whole are counted without being moved.
2. The distinct spans left, grouped by hash, are cut into blocks ("symbols").
   Each shard of them gets its own suffix order and transform. Shards are merged
   by refining their interleave one symbol a round, which also tells after how
   many symbols neighbours part. Windows not parted when the asked length is
   reached repeat. Suffixes are sorted in their shard only.
3. Repeated windows go back to the places of their spans, and each text is cut
   once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .common import text_of
from .hashing import chunks, prefix_sums, substring_hash

LENGTH = 200
GRAM = 32
#: Bytes in a symbol; it divides the length.
SYMBOL = 20
#: Spans merged together in a task, in shards of SHARD_BYTES.
MERGE_BYTES = 1 << 21
SHARD_BYTES = 1 << 18
#: Distinct spans of one hash that a task merges; more are dealt out by window.
HASH_SPANS = 4096


def spans(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, gram hash, span hash) of the runs of windows that share their smallest gram.

    Equal windows have theirs at the same offset, so no two windows of a span
    are equal: each repeat shows as two spans of one gram hash.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    last = len(data) - length  # a text's zero byte is no part of any window
    if last < 0:
        return none
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = substring_hash(sums, at, at + GRAM)
    # The smallest hash, and of equal ones the first: its place fills the low bits.
    mask = np.uint64((1 << max(20, len(data).bit_length())) - 1)
    low = (grams & ~mask) | at.astype(np.uint64)
    width, wanted = 1, length - GRAM + 1
    while 2 * width <= wanted:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = (np.minimum(low[: last + 1], low[wanted - width :][: last + 1]) & mask).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for_text = bounds[1:] - 1 - length  # last window start of each text
    count = for_text - bounds[:-1] + 1
    delta = np.zeros(last + 2, np.int64)
    some = count > 0
    np.add.at(delta, bounds[:-1][some], 1)
    np.add.at(delta, for_text[some] + 1, -1)
    inside = np.cumsum(delta)[: last + 1] > 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (text[1 : last + 1] != text[:last])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:] | fresh[1:], [True]])) + 1
    own = substring_hash(sums, start, stop + length - 1)
    return text[start], start - bounds[text[start]], stop - start, grams[low[start]], own


class Shard:
    """Strings with the order of their suffixes by symbols, and its transform.

    A suffix begins at any byte from which symbols can be cut; the one that
    begins behind a string's last symbol is empty and sorts first.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, names: np.ndarray):
        """``names``: the symbol's number at each byte, -1 where none can be cut.

        A string ends with one byte that is no part of it: an empty suffix can begin there.
        """
        size, length = len(data), np.diff(bounds) - 1
        string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        offset = np.arange(size) - bounds[string]
        before = np.where(offset >= SYMBOL, np.arange(size) - SYMBOL, -1)
        there = (names >= 0) | ((before >= 0) & (names[before] >= 0))
        rank = np.where(names >= 0, names + 1, 0).astype(np.int64)
        step = SYMBOL
        while step <= length.max():
            after = np.minimum(np.arange(size) + step, size - 1)
            behind = np.where(offset + step <= length[string], rank[after], 0)
            rank = np.unique(rank * np.int64(rank.max() + 1) + behind, return_inverse=True)[1].astype(np.int64)
            step *= 2
        place = np.flatnonzero(there)
        # Equal suffixes stay in the order of their strings, as a transform needs it.
        self.order = place[np.lexsort((string[place], rank[place], names[place] >= 0))]
        self.string, self.offset = string[self.order], offset[self.order]
        self.left = length[self.string] - self.offset
        self.bwt = np.where(before[self.order] >= 0, names[np.maximum(before[self.order], 0)], -1)
        self.ends = int((names[self.order] < 0).sum())


def merged(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (which shard is next) and the interval of each place, after ``rounds`` symbols.

    Places in one interval agree on so many symbols. A round walks the present
    interleave, takes each suffix's preceding symbol from its shard's transform,
    and lines the extended suffixes up by that symbol, stably; intervals part
    where the symbols or the old intervals differ.
    """
    bwt = np.concatenate([s.bwt for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.ends for s in shards]).astype(np.uint16)
    z = np.repeat(np.arange(len(shards)), [len(s.bwt) for s in shards]).astype(np.uint16)
    interval = np.zeros(len(z), np.int64)
    for _ in range(rounds):
        symbol = np.empty(len(z), np.int64)
        symbol[np.argsort(z, kind="stable")] = bwt
        there = np.flatnonzero(symbol >= 0)
        symbol = symbol[there]
        # Two stable passes over 16 bits each are a radix sort.
        line = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
        line = line[np.argsort((symbol[line] >> 16).astype(np.uint16), kind="stable")]
        moved = there[line]
        symbol = symbol[line]
        parted = np.ones(len(moved), bool)
        parted[1:] = (symbol[1:] != symbol[:-1]) | (interval[moved[1:]] != interval[moved[:-1]])
        z = np.concatenate([ends, z[moved]])
        interval = np.concatenate([np.zeros(len(ends), np.int64), np.cumsum(parted)])
    return z, interval


def repeated_windows(strings: list[bytes], often: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that occur at least twice in the strings, ``often`` of each being there."""
    sizes = np.array([len(s) + 1 for s in strings])
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = prefix_sums(data)
    at = np.arange(max(0, len(data) - SYMBOL + 1))
    names = np.full(len(data), -1, np.int64)
    inner = np.repeat(bounds[1:], sizes)[: len(at)] > at + SYMBOL
    names[at[inner]] = np.unique(substring_hash(sums, at[inner], at[inner] + SYMBOL), return_inverse=True)[1]
    shards, first = [], []
    string = 0
    while string < len(strings):
        stop = max(string + 1, int(np.searchsorted(bounds, bounds[string] + SHARD_BYTES, "right")) - 1)
        a, b = bounds[string], bounds[stop]
        shards.append(Shard(data[a:b], bounds[string : stop + 1] - a, names[a:b]))
        first.append(string)
        string = stop
    z, interval = merged(shards, length // SYMBOL)
    back = np.argsort(z, kind="stable")
    own = np.concatenate([s.string + f for s, f in zip(shards, first)])
    offset = np.concatenate([s.offset for s in shards])
    left = np.concatenate([s.left for s in shards])
    long = left >= length
    times = np.bincount(interval[back][long], often[own[long]], len(z) + 1)
    found = np.flatnonzero(long & (times[interval[back]] >= 2))
    return own[found], offset[found]


def _runs(own: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts: (string, first, one past the last)."""
    order = np.lexsort((offset, own))
    own, offset = own[order], offset[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1)
    start = np.flatnonzero(fresh)
    stop = np.concatenate([start[1:], [len(own)]])
    return own[start], offset[start], offset[stop - 1] + 1


def _merge_task(length: int):
    names = ["gram", "span", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[int] = []
        own: list[int] = []
        often: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            who, a, b = _runs(*repeated_windows(texts, np.array(often), length))
            return pa.RecordBatch.from_arrays([pa.array(np.array(grams)[who]), pa.array(np.array(own)[who]), pa.array(a), pa.array(b)], names=names)

        for batch in batches:
            for gram, span, many, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "many", "bytes"))):
                if texts and (gram, span) == (grams[-1], own[-1]):
                    continue  # read from a repeated row as well
                if size > MERGE_BYTES and gram != grams[-1]:
                    yield flush()
                    grams, own, often, texts, size = [], [], [], [], 0
                grams.append(gram)
                own.append(span)
                often.append(min(many, 2))
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return run


def _window_task(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, span, many, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "many", "bytes"))):
                sums = prefix_sums(np.frombuffer(text, np.uint8))
                at = np.arange(len(text) - length + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * n, pa.int64()), pa.array([span] * n, pa.int64()), pa.array(at), pa.array(substring_hash(sums, at, at + length).view(np.int64)), pa.array([min(many, 2)] * n, pa.int64())],
                    names=["gram", "span", "a", "w", "many"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, on demand) per row.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in any text, on the input; matches stay inside texts. Null text is
    empty; shorter texts stay whole; repeated rows repeat each other and go
    whole; null ids are ids; other columns are ignored; an empty table gives no
    rows. Strings are told apart by their 64-bit hashes.
    """
    if length % SYMBOL or length <= GRAM:
        raise ValueError(f"the length must be a multiple of {SYMBOL} over {GRAM}")
    kind = docs.schema[id_col].dataType.simpleString()
    # A row is named by two hashes of its content: equal rows have equal answers.
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.xxhash64(F.lit("row"), "text", "doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in chunks(batch.column("text")):
                text, start, windows, gram, span = spans(data, bounds, length)
                row = pa.array(at + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("r1").take(row), batch.column("r2").take(row), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(span.view(np.int64))],
                    names=["r1", "r2", "start", "windows", "gram", "span"],
                )

    found = stash(texts.select("r1", "r2", "text").mapInArrow(cut, "r1 long, r2 long, start long, windows int, gram long, span long"), "spans")
    shared = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1")
    shared = stash(shared.select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    near = stash(found.join(shared, "gram"), "shared-spans")

    # Distinct spans of the mixed grams, with one place each to read their bytes from.
    place = F.min(F.struct("r1", "r2", "start", "windows")).alias("p")
    distinct = stash(near.filter("mixed").groupBy("gram", "span").agg(F.count("*").alias("many"), place), "distinct-spans")
    crowded = distinct.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HASH_SPANS).select("gram", F.lit(True).alias("crowded"))
    wanted = distinct.join(stash(crowded, "crowded-grams"), "gram", "left")
    wanted = wanted.groupBy("p.r1", "p.r2").agg(F.collect_list(F.struct("p.start", "p.windows", "gram", "span", "many", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("s"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("s")):
                data = text.as_py().encode()
                rows = asked.as_py()
                yield pa.RecordBatch.from_pylist(
                    [{"gram": r["gram"], "span": r["span"], "many": r["many"], "crowded": r["crowded"], "bytes": data[r["start"] : r["start"] + r["windows"] + length - 1]} for r in rows],
                    pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("many", pa.int64()), ("crowded", pa.bool_()), ("bytes", pa.binary())]),
                )

    once = texts.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).select("text", "s")
    pieces = stash(once.mapInArrow(read, "gram long, span long, many long, crowded boolean, bytes binary"), "span-bytes")
    few = pieces.filter("NOT crowded").repartition("gram").sortWithinPartitions("gram", "span")
    merged_runs = few.select("gram", "span", "many", "bytes").mapInArrow(_merge_task(length), "gram long, span long, a long, b long")
    # A gram with very many distinct spans is dealt out window by window.
    crowd = pieces.filter("crowded").select("gram", "span", "many", "bytes").dropDuplicates(["gram", "span"])
    windows = stash(crowd.mapInArrow(_window_task(length), "gram long, span long, a long, w long, many long"), "windows")
    again = windows.groupBy("w").agg(F.sum("many").alias("n")).filter("n > 1").select("w")
    single = windows.join(again, "w", "left_semi").select("gram", "span", "a", (F.col("a") + 1).alias("b"))
    runs = stash(merged_runs.unionByName(single), "window-runs")

    whole = near.filter("NOT mixed").select("r1", "r2", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))
    part = near.filter("mixed").join(runs, ["gram", "span"]).select("r1", "r2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    covered = stash(whole.unionByName(part).groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b")).alias("s")), "covered")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, sha, rest = [], [], [], []
            for text, asked in zip(batch.column("text"), batch.column("s")):
                data = text.as_py().encode()
                kept, gone, runs_here, at = [], 0, 0, 0
                end = -1
                for r in sorted((r["a"], r["b"] + length - 1) for r in asked.as_py() or ()):
                    if r[0] > end:
                        runs_here += 1
                        kept.append(data[max(end, 0) : r[0]])
                    gone += max(0, r[1] - max(end, r[0]))
                    end = max(end, r[1])
                kept.append(data[max(end, 0) :])
                body = b"".join(kept)
                removed.append(gone)
                count.append(runs_here)
                sha.append(hashlib.sha256(body).hexdigest())
                rest.append(body if with_text else None)
            out = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).join(covered, ["r1", "r2"], "left").drop("r1", "r2")
    done = rows.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")
