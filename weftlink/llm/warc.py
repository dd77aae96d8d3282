"""WARC archives as a Spark data source, written and read record by record.

Reading plans one partition per run of files, takes filters on the record type
and on headers, parses a record's headers first, and passes over payloads that
no wanted row needs without decoding them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import new_table_path, stash
from .common import text_of

# Header names and the revisit profile of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column by header. The last is ours: a revisit carries no payload to measure.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to_id": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
    "page_id": "X-Page-ID",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to_id string, payload_bytes long, page_id long, payload binary"
NUMBERS = ("payload_bytes", "page_id")
#: A batch of rows handed to Spark holds about this many payload bytes.
BATCH_BYTES = 4 << 20
FILE_BYTES = 64 << 20
# Fixed value: records need a date; pages have none, so all carry the epoch.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(" " if c in "\r\n" else c for c in value)


def record_bytes(fields: dict, payload: bytes) -> bytes:
    """One record as its own gzip member, so that a reader can start at any of them."""
    lines = [VERSION]
    for column, header in HEADERS.items():
        value = fields.get(column)
        if value is not None:
            lines.append(f"{header}: {_clean(str(value))}")
    if fields["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 5, mtime=0)


def read_headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's headers by lower-case name; None at the end. The first line must name a WARC version."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    if "content-length" not in found:
        raise ValueError("a WARC record has no Content-Length")
    return found


def records(stream: io.BufferedIOBase, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Wanted records; other payloads, or all of them without ``payloads``, are skipped unread."""
    while (headers := read_headers(stream)) is not None:
        length = int(headers["content-length"])
        fields = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        for c in NUMBERS:
            fields[c] = int(fields[c]) if fields[c] is not None else None
        if payloads and wanted(fields):
            payload = stream.read(length)
            if len(payload) < length:
                raise ValueError("a WARC record ends early")
            yield fields, payload
        else:
            stream.seek(length, io.SEEK_CUR)
            if wanted(fields):
                yield fields, None


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, columns: list[str]):
        self.path, self.payloads, self.columns = path, payloads, columns
        self.equal: list[tuple[str, tuple]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):
        """Takes equality, IN and IS NOT NULL on headers; leaves the rest to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.equal.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.equal.append((column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.present.append(column)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Runs of files of about ``FILE_BYTES`` together."""
        files, base = pafs.FileSystem.from_uri(self.path)
        found = sorted((f for f in files.get_file_info(pafs.FileSelector(base)) if f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        runs, size = [], FILE_BYTES
        for f in found:
            if size + f.size > FILE_BYTES:
                runs.append([])
                size = 0
            runs[-1].append(f.path)
            size += f.size
        return [Files(r) for r in runs] or [Files([])]

    def wanted(self, fields: dict) -> bool:
        return all(fields[c] in values for c, values in self.equal) and all(fields[c] is not None for c in self.present)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([(c, pa.int64() if c in NUMBERS else pa.binary() if c == "payload" else pa.string()) for c in self.columns])
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as raw:
                plain = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                for fields, payload in records(plain, self.wanted, self.payloads):
                    rows.append({**fields, "payload": payload})
                    size += 500 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """A task writes files under names of its attempt; the commit gives them their own."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = pafs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        moves: list[tuple[str, str]] = []
        out, size = None, FILE_BYTES
        for batch in iterator:
            for row in batch.to_pylist():
                if size >= FILE_BYTES:
                    if out:
                        out.close()
                    name = f"part-{part:06d}-{len(moves):04d}-{self.job}.warc.gz"
                    moves.append((f"{base}/_{name}.{attempt}", f"{base}/{name}"))
                    out, size = files.open_output_stream(moves[-1][0], compression=None), 0
                member = record_bytes(row, row.get("payload") or b"")
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(moves)

    def commit(self, messages) -> None:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for a, b in message.moves if message else ():
                files.move(a, b)

    def abort(self, messages) -> None:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for a, _ in message.moves if message else ():
                files.delete_file(a)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payloads", "false").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() == "true", schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], uuid.uuid4().hex[:8])


def page_records(pages: DataFrame) -> DataFrame:
    """Rows for the writer: one record per page, repeated payloads as revisits of the smallest page_id.

    Payloads are told apart by SHA-256 and length; only pairs of digest and id
    are grouped. A page without html has an empty payload, a null page_id no
    X-Page-ID header; the response of a group whose ids are all null, and of
    rows that repeat the smallest id, is any one of them.
    """
    payload = text_of("html").cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.sha2("payload", 256)), "payloads")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    again = rows.groupBy("_key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = stash(again.select("_key", "_first"), "repeated-payloads")
    rows = rows.join(again, "_key", "left")
    revisit = F.coalesce(F.col("_row") != F.col("_first._row"), F.lit(False))
    sha1 = F.unhex(F.sha1("payload"))
    rows = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("row-"), "_row")), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit(DATE).alias("date"),
        sha1.alias("_sha1"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_first.page_id").cast("string"), F.concat(F.lit("row-"), F.col("_first._row"))), F.lit(">"))).alias("refers_to_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "page_id",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )

    def in_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pa.array(["sha1:" + base64.b32encode(x.as_py()).decode() for x in b.column("_sha1")], pa.string())
            yield b.set_column(b.schema.get_field_index("_sha1"), "payload_digest", coded)

    return rows.mapInArrow(in_base32, SCHEMA)


def write_warc(pages: DataFrame, path: str | None = None) -> str:
    """Archive ``pages`` (page_id, url, html) under ``path``, a folder all executors reach; returns it."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    path = path or new_table_path(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records under ``path``; filters on its header columns are taken by the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken anew from the payload read; those
    of a revisit, which has no payload, from its headers. An empty table gives
    no rows.
    """
    found = read_warc(pages.sparkSession, write_warc(pages))
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own = r["record_type"] == "response"
                target = (r["refers_to_id"] or "").removeprefix("<urn:page:").removesuffix(">")
                rows.append({
                    "page_id": r["page_id"],
                    "payload_bytes": len(r["payload"]) if own else r["payload_bytes"],
                    "payload_digest": digest(r["payload"]) if own else r["payload_digest"].removeprefix("sha1:"),
                    "record_type": r["record_type"],
                    "refers_to": int(target) if target and not target.startswith("row-") else None,
                })
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return found.mapInArrow(told, kind)
