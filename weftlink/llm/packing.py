"""Packing token sequences by patterns.

The histogram of lengths is fitted by repeat counts of few-document patterns
that fill a sequence exactly (non-negative least squares); the counts are
rounded, and what is left is packed best-fit decreasing, both on the histogram.
Documents then take the places of their length by rank, in parallel.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .common import lean, text_of

CAPACITY = 2048
END = struct.pack("<I", 0)
FIT_ROUNDS = 60
#: Rows of one length are ranked in this many parts.
RANK_PARTS = 128
#: What a worker remembers of words, parts of words and their tokens, in bytes; forgotten when full.
REMEMBER_BYTES = 64 << 20
#: What an entry takes beside its strings.
ENTRY_BYTES = 180
_WORKER: dict = {}

# Words that can be taken apart: ASCII and the Latin-1 letters, which stay as
# they are under composition, and neither an apostrophe (it begins tokens of its
# own) nor a bar (special tokens have one). All others are tokenised whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[!-&(-{{}}~{_LETTERS}]+").fullmatch
_PARTS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}]+").findall


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordTokens:
    """Token ids as bytes by white-space separated word.

    The tokenizer lower-cases, drops white space and never joins across it, nor
    across the end of a run of letters; so a text's ids are those of its words
    in turn, and a simple word's those of its runs. What repeats is tokenised
    once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.room = REMEMBER_BYTES

    def remember(self, table: dict, key: str | bytes, found: bytes) -> None:
        self.room -= ENTRY_BYTES + len(key) + len(found)
        if self.room < 0:
            self.words.clear()
            self.parts.clear()
            self.room = REMEMBER_BYTES
        table[key] = found

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if part.isalpha():
                coded = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                found = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
            else:
                found = self.whole(part)
            self.remember(self.parts, part, found)
        return found

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if _SIMPLE(text):
            text = text.lower()
            found = self.part(text) if text.isalpha() else b"".join([self.part(p) for p in _PARTS(text)])
        else:
            found = self.whole(text)
        self.remember(self.words, word, found)
        return found

    def __call__(self, text: str) -> bytes:
        known, new = self.words.get, self.word
        return b"".join([known(w) or new(w) for w in text.encode().split()])


def word_tokens(path: str) -> WordTokens:
    """One per worker process, kept between tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordTokens(path)
    return _WORKER[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of at most ``capacity`` ids; only longer documents are cut."""
    kind = docs.schema["doc_id"].dataType
    schema = "piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(lean(cut), f"doc_id {kind.simpleString()}, {schema}")


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Every multiset of at most three of the lengths that fills a sequence: rows of three, 0 for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [(np.full((1, 3), capacity) * [1, 0, 0])] if there[capacity] else []
    for a in lengths[lengths < capacity]:
        if 2 * a <= capacity and there[capacity - a]:
            found.append(np.array([[a, capacity - a, 0]]))
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[there[b] & there[capacity - a - b]] if len(b) else b
        if len(b):
            found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative repeats x with (patterns' lengths) @ x near ``counts``, by multiplicative least-squares steps."""
    size = len(counts)
    weight = np.arange(size, dtype=float)  # a long document left over costs more
    used = patterns > 0
    gather = lambda v: (v[patterns] * used).sum(1)
    wanted = gather(counts * weight)
    x = np.full(len(patterns), counts.sum() / max(1, len(patterns)) / 3)
    for _ in range(rounds):
        have = np.bincount(patterns[used], np.repeat(x[:, None], 3, 1)[used], size)
        x *= wanted / np.maximum(gather(have * weight), 1e-12)
    return x


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places for ``counts[length]`` documents; and the number of sequences.

    A place is a row (length, first rank, last rank + 1, first sequence,
    offset): rank r of that length goes to sequence ``first sequence + r - first
    rank``. The number of rows depends on the lengths, not on the documents.
    """
    left = counts.astype(np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        x = fit_repeats(patterns, left.astype(float))
        order = np.argsort(-x, kind="stable")
        # Rounded along the running sum, so that many small counts keep their total.
        repeats = np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0).astype(np.int64)
        for k in np.flatnonzero(repeats):
            lengths = [int(v) for v in patterns[order[k]] if v]
            times = min(int(repeats[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if times > 0:
                for v in lengths:
                    left[v] -= times
                groups.append((tuple(lengths), times))
    groups += best_fit(left, capacity)
    places, ranks, first = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in groups:
        offset = 0
        for v in lengths:
            places.append((v, ranks[v], ranks[v] + times, first, offset))
            ranks[v] += times
            offset += v
        first += times
    return np.array(sorted(places), np.int64).reshape(-1, 5), first


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: groups (lengths in a sequence, how many such sequences)."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for v in range(capacity, 0, -1):
        todo = int(left[v])
        while todo:
            space = next((r for r in range(v, capacity + 1) if room[r]), 0)
            if not space:
                each = capacity // v
                room[capacity].append(((), -(-todo // each)))
                space = capacity
            lengths, times = room[space].pop()
            used = min(times, todo)
            if used < times:
                room[space].append((lengths, times - used))
            room[space - v].append(((*lengths, v), used))
            todo -= used
    return [g for r in room for g in r if g[0]]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``.

    Null and empty texts are one end id; repeated rows are packed one by one;
    null ids are packed like others; other columns are ignored; an empty table
    gives no rows. The driver sees one count per length.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity)
    pieces = stash(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(RANK_PARTS))), "pieces")
    sizes = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stash(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places, _ = plan_sequences(counts, capacity)
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("_at", F.row_number().over(within) - 1).join(sizes.drop("_n"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
    stride = np.int64(1) << 44
    keys = places[:, 0] * stride + places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("_rank", "length"))
            at = places[np.searchsorted(keys, length * stride + rank, "right") - 1] if len(keys) else places
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
