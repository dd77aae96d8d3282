"""Spelling variants: words that differ by one letter, found on a relational trie.

The vocabulary's prefixes are the nodes of a trie, kept as an edge table (parent,
letter) with what lies below each edge. Search states (word, position, node,
edits) walk it one depth at a time: a level is one join of the frontier with the
edges of its depth. States that end on a word after one edit are its neighbours.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, new_table_path, stash
from .common import text_of
from .hashing import chunks

#: Deepest trie level. Longer words have one of their halves in common with a neighbour; see ``long_neighbours``.
LEVELS = 64
#: Texts that are counted together, in bytes.
COUNT_BYTES = 4 << 20
#: A letter's place among the bits that tell which letters may follow; letters that share one only cost a join more.
LETTER_BITS = 63
#: A level's edges are sent to the frontier's tasks if there are no more; else both sides are shuffled by node.
SEND_EDGES = 100_000


def crc_table() -> np.ndarray:
    """The table of CRC-32 (polynomial 0xEDB88320) for one byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = crc_table()


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of a-z and U+00C0..U+00FF start and end, and which bytes they cover."""
    # In UTF-8 these letters are all that begins with 0xC3, which is never a later byte.
    lead = data == 0xC3
    letter = ((data >= 97) & (data <= 122)) | lead
    letter[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), letter


def counted_runs(ids: list[str], texts: pa.Array, every: int, letters: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, counts) of runs of texts: words of at least ``letters`` code points, misspelt ones included.

    The CRC of ``<id>:<run>`` is the id's, moved on by the run's bytes, exclusive-or
    the run's own; so it takes one step for each distinct run and each length.
    """
    for at, data, bounds in chunks(texts, COUNT_BYTES):
        data[(data >= 65) & (data <= 90)] |= 32
        start, end, letter = _runs(data)
        if not len(start):
            continue
        size = end - start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        body = data[letter]
        runs = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        coded = runs.dictionary_encode()
        word, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        own = np.array([zlib.crc32(w) for w in known.cast(pa.large_binary()).to_pylist()], np.uint32)
        doc = np.searchsorted(bounds, start, "right") - 1
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[at : at + len(bounds) - 1]], np.uint32)
        moved = [before]
        for _ in range(min(int(size.max()), LEVELS)):
            moved.append(_CRC[moved[-1] & np.uint32(255)] ^ (moved[-1] >> np.uint32(8)))
        crc = np.stack(moved)[np.minimum(size, LEVELS), doc] ^ own[word]
        for k in np.flatnonzero(size > LEVELS):
            crc[k] = zlib.crc32(known[int(word[k])].as_py().encode(), int(before[doc[k]]))
        odd = crc % np.uint32(every) == 0
        misspelt: Counter[str] = Counter()
        for k in np.flatnonzero(odd):
            run = known[int(word[k])].as_py()
            gone = int(crc[k]) % len(run)
            if len(run) > letters:
                misspelt[run[:gone] + run[gone + 1 :]] += 1
        counts = np.bincount(word[~odd], minlength=len(known))
        kept = (counts > 0) & (pc.utf8_length(known).to_numpy(zero_copy_only=False) >= letters)
        yield known.filter(pa.array(kept)), counts[kept]
        if misspelt:
            yield pa.array(list(misspelt), pa.large_string()), np.array(list(misspelt.values()), np.int64)


def word_counts(docs: DataFrame, every: int = 199, letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, only A-Z lower-cased, and how often they occur.

    In documents where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, the
    run's code point at that number modulo its length is left out. Words have at
    least ``letters`` code points and occur at least ``least`` times overall.
    Null texts have no runs; a null id is spelt empty; repeated rows count each
    time; other columns are ignored; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in counted_runs(batch.column("id").to_pylist(), batch.column("text"), every, letters):
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _letter(word: str | Column, position: Column) -> Column:
    """The code point at a position from 0; empty behind the end."""
    return F.substr(F.col(word) if isinstance(word, str) else word, position + 1, F.lit(1))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def _letter_bit(letter: Column) -> Column:
    return F.when(letter == "", F.lit(0).cast("long")).otherwise(_bit(F.ascii(letter) % LETTER_BITS))


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, parent, letter, ends, after) of the trie of ``words``, in the order of depth.

    A node is its prefix. Bit r of ``ends`` says that a word ends r letters below
    the edge's lower node, bits of ``after`` which letters go on from there. A
    node that many words share is summed up by each task before it is shuffled.
    """
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    edges = steps.select(
        "depth",
        F.left(F.col("word"), F.col("depth")).alias("parent"),
        _letter("word", F.col("depth")).alias("letter"),
        _bit(F.length("word") - 1 - F.col("depth")).alias("ends"),
        _letter_bit(_letter("word", F.col("depth") + 1)).alias("after"),
    )
    edges = edges.groupBy("depth", "parent", "letter").agg(F.bit_or("ends").alias("ends"), F.bit_or("after").alias("after"))
    return stash(edges.orderBy("depth", "parent"), "trie")


def next_frontier(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """States one depth lower: ``frontier`` (word, pos, node, edits) joined with the edges of its nodes.

    Without an edit so far, a word goes on along its own letter or, as a
    replacement, along any smaller one; and behind its own letter it may leave
    out the next, of equal ones the last. Insertions and replacements by larger
    letters are the same pairs seen from the other word. After the edit only the
    word's own letters are followed. A state lives on if a word of the right
    length and the next letter lie below.
    """
    own = _letter("word", F.col("pos"))
    step = (F.col("letter") == own) | ((F.col("edits") == 0) & (F.col("letter") < own))
    met = frontier.join(edges, (F.col("node") == F.col("parent")) & step)
    same = (F.col("edits") == 0) & (F.col("letter") == own)
    met = met.select(
        "word",
        (F.col("pos") + F.when(same, 2).otherwise(1)).alias("pos"),
        F.concat("node", "letter").alias("node"),
        same.alias("left_out"),
        "ends",
        "after",
    )
    left = F.length("word") - F.col("pos")
    here, last = _letter("word", F.col("pos")), _letter("word", F.col("pos") - 1)
    ends = F.col("ends").bitwiseAND(_bit(F.greatest(left, F.lit(0)))) != 0
    goes_on = F.col("after").bitwiseAND(_letter_bit(here)) != 0
    alive = (left >= 0) & ends & ((left == 0) | (goes_on & ~(F.col("left_out") & (here == last))))
    return met.filter(alive).select("word", "pos", "node", (left == 0).alias("found"))


def trie_neighbours(words: DataFrame, longest: int) -> DataFrame:
    """(word, node): pairs of distinct ``words`` of at most ``longest`` letters one edit apart, each once."""
    spark = words.sparkSession
    edges = trie_edges(words)
    few = {r["depth"] for r in edges.groupBy("depth").count().collect() if r["count"] <= SEND_EDGES}
    root = F.lit("")
    # The first letter left out: no edge leads to the root.
    states = words.filter(_letter("word", F.lit(0)) != _letter("word", F.lit(1))).filter(F.length("word") > 1)
    states = states.select("word", F.lit(1).alias("pos"), root.alias("node"))
    schema = "word string, pos int, node string, depth int, found boolean"
    levels = new_table_path(spark, "frontier")
    for depth in range(longest):
        untouched = words.filter(F.length("word") > depth).select(
            "word", F.lit(depth).alias("pos"), F.left(F.col("word"), F.lit(depth)).alias("node"), F.lit(0).alias("edits")
        )
        frontier = untouched.unionByName(states.withColumn("edits", F.lit(1)))
        path = f"{levels}/depth={depth}"
        below = edges.filter(F.col("depth") == depth)
        next_frontier(frontier, F.broadcast(below) if depth in few else below).write.partitionBy("found").parquet(path)
        if depth:
            delete_path(spark, f"{levels}/depth={depth - 1}/found=false")
        level = spark.read.schema(schema).option("basePath", levels).parquet(path)
        states = level.filter(~F.col("found")).select("word", "pos", "node")
    return spark.read.schema(schema).parquet(levels).filter("found").select("word", "node")


def long_neighbours(words: DataFrame) -> DataFrame:
    """(word, node): pairs of long ``words`` one edit apart, each once.

    The edit leaves the first or the last half of the shorter word's length
    intact in both; equal halves meet, and the distance decides.
    """

    def halves(size: Column) -> DataFrame:
        half = F.expr("size div 2")
        sides = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(F.left(F.col("word"), half)).alias("key")), F.struct(F.lit(1).alias("side"), F.xxhash64(F.right(F.col("word"), half)).alias("key")))
        return words.withColumn("size", size).select("word", "size", F.inline(sides))

    shorter = halves(F.length("word")).withColumnRenamed("word", "node")
    longer = halves(F.explode(F.array(F.length("word"), F.length("word") - 1)))
    met = longer.join(shorter, ["size", "side", "key"]).filter((F.length("word") > F.length("node")) | (F.col("word") > F.col("node")))
    return met.filter(F.levenshtein("word", "node", 1) == 1).select("word", "node").distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): both directions of all pairs of distinct ``words`` one edit apart."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pairs = words.select("word", F.col("word").alias("node")).limit(0)
    if longest:
        pairs = trie_neighbours(words.filter(F.length("word").between(1, LEVELS)), min(longest, LEVELS))
    if longest > LEVELS:
        # Pairs at the border are in both halves of the vocabulary.
        pairs = pairs.unionByName(long_neighbours(words.filter(F.length("word") >= LEVELS))).distinct()
    pairs = pairs.select("word", F.col("node").alias("near"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of the forms that follow from the word.

    Every round follows twice as many; a form is ``times`` as frequent as its
    word, so chains are short and rounds few.
    """
    found = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stash(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        found = further.drop("moved")
        if further.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary ``words`` (word, n) of distinct words.

    A word's form is its most frequent neighbour (ties: the smallest by code
    point) if that is at least ``times`` as frequent as the word, else null. Its
    root is the last of the forms that follow. ``n_near`` counts neighbours.
    Null and empty words have none; other columns are ignored; an empty table
    gives no rows.
    """
    words = stash(words.select("word", "n"), "words")
    frequency = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = neighbours(words.filter(F.col("word").isNotNull())).join(frequency, "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.n") >= times * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"),
        F.when(fits, -F.col("best.n")).alias("form_n"),
    )
    formed = stash(formed, "forms")
    rooted = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of ``docs``; see ``word_counts`` and ``variants``."""
    return variants(word_counts(docs))
