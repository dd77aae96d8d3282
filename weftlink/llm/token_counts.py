"""Token counts by way of a digest cache.

A count depends on the normalised content and on the tokenizer's version only.
Both digests are the key of a stored table; what it lacks is encoded once per
distinct content and appended to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import child_names, delete_path, new_table_path, stash
from .common import text_of

#: The sign that stands for a space inside sentencepiece.
MARK = "▁"
LIMIT = 4096
#: Texts whose words are encoded together, in bytes; a longer text alone.
CHUNK_BYTES = 8 << 20
#: Below so many bytes of wanted digests, the digests go to the texts; beyond, texts are reduced to distinct ones first.
SEND_BYTES = 4 << 20
_CACHE_SCHEMA = "digest binary, n_tokens int"
_WORKER: dict[str, Callable[[pa.Array], np.ndarray]] = {}


class PieceCounts:
    """Numbers of sentencepiece tokens, each distinct word of a chunk of texts encoded once.

    A text begins with a mark of its own, and spaces are marks. Where no piece
    has a mark behind another letter, no merge crosses from a word into the marks
    behind it: the text's tokens are those of its words, each with the marks
    before it, and encoding a word alone puts its first mark in front.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = self.words_are_apart()

    def words_are_apart(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rule, kinds = model.normalizer_spec, model.SentencePiece
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        bpe = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        special = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        pieces = [p.piece for p in model.pieces]
        return plain and bpe and not special and MARK in pieces and not any(b == MARK != a for p in pieces for a, b in zip(p, p[1:]))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.array([len(self.model.encode(t.as_py())) for t in texts], np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.cumsum(size) // CHUNK_BYTES
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist() + [len(texts)]
        found = [self.by_words(texts.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        return np.where(size == 0, 0, np.concatenate([np.zeros(0, np.int64), *found]))

    def by_words(self, texts: pa.Array) -> np.ndarray:
        # All marks of a run but the first go to the word behind them; the first one is where the text is cut.
        none, space = (pa.scalar(c, pa.large_string()) for c in ("", " "))
        spaced = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")
        spaced = pc.binary_join_element_wise(space, spaced, none)
        if pc.any(pc.match_substring(spaced, "  ")).as_py():
            spaced = pc.replace_substring(pc.replace_substring(spaced, "  ", " " + MARK), MARK + " ", MARK * 2)
        words = pc.split_pattern(spaced, " ")
        coded = words.flatten().dictionary_encode()
        n = np.array([len(ids) for ids in self.model.encode(coded.dictionary.to_pylist(), num_threads=1)], np.int64)
        n = np.maximum(n, 1)  # a mark without a word
        each = n[coded.indices.to_numpy(zero_copy_only=False)]
        starts = np.asarray(words.offsets)[:-1] - words.offsets[0].as_py()
        return np.add.reduceat(each, starts) - 1  # the empty string before the first mark


def text_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Numbers of tokens of texts by the library of the file: sentencepiece for ``.model``, tokenizers for ``.json``."""
    if path.endswith(".model"):
        return PieceCounts(path)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: np.array([len(model.encode(t.as_py(), add_special_tokens=False).ids) for t in texts], np.int64)


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def normalised(text: Column, tokenizer_path: str) -> Column:
    """Texts that the tokenizer can't tell apart become one: sentencepiece reads its mark as a space."""
    return F.replace(text, F.lit(MARK), F.lit(" ")) if tokenizer_path.endswith(".model") else text


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version. Runs that appended the same digest agree.

    A table in any case, so that a join with a digest that many rows have can be split.
    """
    appends = child_names(spark, folder)
    if not appends:
        return spark.createDataFrame([], _CACHE_SCHEMA)
    rows = spark.read.option("recursiveFileLookup", "true").schema(_CACHE_SCHEMA).parquet(folder)
    return rows if len(appends) == 1 else stash(rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "stored")


def compact(spark: SparkSession, cache: str, tokenizer_path: str) -> None:
    """Fold the appends of a version into one. Stopped half-way, it leaves rows twice, which does no harm."""
    folder = f"{cache}/{tokenizer_version(tokenizer_path)}"
    old = child_names(spark, folder)
    if len(old) > 1:
        stored_counts(spark, folder).write.parquet(f"{folder}/{uuid.uuid4().hex}")
        for name in old:
            delete_path(spark, f"{folder}/{name}")


def append_misses(texts: DataFrame, wanted: DataFrame, folder: str, tokenizer_path: str) -> None:
    """Encode one text of each of the ``wanted`` digests and append the counts to ``folder``.

    Each append is a folder of its own, so that runs don't meet; a run that is
    lost on the way leaves right rows or none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _WORKER.get(tokenizer_path) or _WORKER.setdefault(tokenizer_path, text_counter(tokenizer_path))
        for batch in batches:
            n = pa.array(count(batch.column("text")), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), n], names=["digest", "n_tokens"])

    few = 32 * wanted.count() <= SEND_BYTES
    if few:
        texts = texts.join(F.broadcast(wanted), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if not few:
        texts = texts.join(wanted, "digest", "left_semi")
    texts.mapInArrow(encode, _CACHE_SCHEMA).write.parquet(f"{folder}/{uuid.uuid4().hex}")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, by the stored counts in the folder ``cache``.

    Counts are of whole texts, without special tokens. Name a lasting ``cache``
    to keep them for later runs; without one, it serves this run. Null texts
    count as empty; repeated rows, repeated and null ids are counted row by row;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{cache or new_table_path(spark, 'token-cache')}/{tokenizer_version(tokenizer_path)}"
    rows = docs.select("doc_id", text_of().alias("given"))
    rows = rows.withColumn("text", normalised(F.col("given"), tokenizer_path))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = stash(rows.select("doc_id", F.octet_length("given").cast("long").alias("n_bytes"), "digest"), "digests")
    wanted = keys.select("digest").distinct().join(stored_counts(spark, folder), "digest", "left_anti")
    wanted = stash(wanted, "misses")
    if not wanted.isEmpty():
        append_misses(rows.select("digest", "text"), wanted, folder, tokenizer_path)
    counted = keys.join(stored_counts(spark, folder), "digest", "left")
    n = F.col("n_tokens").cast("long")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
