"""WARC archives: writing records, reading them back, and turning repeated payloads into revisit records.

Only headers are shuffled by payload digest: the table of originals is a grouped maximum over (digest, record id), so a
payload that a third of all records share costs one row per map task. Each record is a gzip member of its own, made in
Python from bytes, so payloads need not be text. Archives are written by Spark's text writer, an archive a row, with its
commit protocol and any file system that Spark can reach. Between records is another, constant member that
holds the blank lines which end a record; the writer puts it after each row. Reading goes file by file and record by record, by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive, before compression; one task holds an archive whole. A larger record has its own.
ARCHIVE_BYTES = 64 << 20
#: Records in an archive at most, and archives that the driver renames at once.
RECORDS_PER_ARCHIVE, RENAMED_AT_ONCE = 5_000, 32
#: Compression level; a member ends with the record's block, and the next one holds the lines between records.
LEVEL = 6
BETWEEN = gzip.compress(b"\r\n\r\n", LEVEL, mtime=0)
_NAME = "urn:x-record:"
_RECORD_SCHEMA = (
    "record_id long, record_name string, target_uri string, date string, record_type string, refers_to long, refers_to_name string, "
    "refers_to_uri string, refers_to_date string, payload_bytes long, payload_digest string, payload binary"
)


def responses(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """A response record for each row; a null payload (string or binary) counts as empty. Other columns are ignored."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(uri_col).alias("target_uri"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.lit("response").alias("record_type"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
        payload.alias("payload"),
    )


def resolve_revisits(records: DataFrame, *, min_bytes: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``records`` with ``record_type`` and what revisits refer to settled, and without the payloads of revisits.

    Of the responses with equal payloads of at least ``min_bytes``, the one with the largest ``record_id`` (of those
    without one, with the largest ``record_name``) stays a response, and so do rows that repeat it; the others become
    revisits that refer to it, as do records that come in as revisits of the same payload. A revisit whose response is
    not among ``records`` keeps what it came in with. Smaller payloads are left alone. Columns that ``records`` lacks
    count as null; others are kept. An empty table gives no rows.

    Up to ``broadcast_rows`` originals are broadcast. Beyond that, headers are joined to originals by digest, and the
    revisits found so to the records by name and digest, so that payloads never meet by digest.
    """
    types = dict(field.split() for field in _RECORD_SCHEMA.split(", "))
    lacking = {c: F.lit(None).cast(types[c]) for c in ("record_name", "refers_to", "refers_to_name", "refers_to_uri", "refers_to_date") if c not in records.columns}
    records = records.withColumns(lacking) if lacking else records
    own = F.struct("record_id", "record_name")
    heads = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).select("payload_digest", own.alias("__own"), "target_uri", "date")
    repeated = heads.groupBy("payload_digest").agg(F.max(F.struct("__own", "target_uri", "date")).alias("__original"), F.count("*").alias("__n"))
    came_in = records.where("record_type = 'revisit'").select("payload_digest").distinct().withColumn("__wanted", F.lit(True))
    originals = written(
        repeated.join(came_in, "payload_digest", "left")
        .where("(__original.__own.record_id is not null or __original.__own.record_name is not null) and (__n > 1 or __wanted)")
        .select("payload_digest", "__original")
    )
    if originals.count() <= broadcast_rows:
        joined = records.join(F.broadcast(originals), "payload_digest", "left")
    else:
        heads = records.select(own.alias("__own"), "payload_digest").join(originals, "payload_digest")
        found = heads.where(~F.col("__own").eqNullSafe(F.col("__original.__own"))).distinct().withColumnRenamed("payload_digest", "__digest")
        same = own.eqNullSafe(F.col("__own")) & (F.col("payload_digest") == F.col("__digest"))
        joined = records.join(found, same, "left").drop("__own", "__digest")
    again = F.col("__original").isNotNull() & ~own.eqNullSafe(F.col("__original.__own"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.col("record_type"))
    revisit = kind == "revisit"
    settled = {
        "refers_to": F.col("__original.__own.record_id"),
        "refers_to_name": F.col("__original.__own.record_name"),
        "refers_to_uri": F.col("__original.target_uri"),
        "refers_to_date": F.col("__original.date"),
    }
    linked = {c: F.when(again, found).when(revisit, F.col(c)) for c, found in settled.items()}
    return joined.withColumns(linked | {"record_type": kind, "payload": F.when(~revisit, F.col("payload"))}).drop("__original")


def record_bytes(row: dict) -> bytes:
    """A record's headers and block. Responses have an HTTP header and the payload, revisits the same header alone, so both tell the payload's length."""
    urn = lambda key, name: f"<{name or f'{_NAME}{key}'}>" if key is not None or name else None
    revisit = row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    if not revisit:
        block += row["payload"] or b""
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": urn(row["record_id"], row["record_name"]) or f"<{_NAME}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": urn(row["refers_to"], row["refers_to_name"]),
        "WARC-Refers-To-Target-URI": row["refers_to_uri"],
        "WARC-Refers-To-Date": row["refers_to_date"],
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{name}: {_LINE_ENDS.sub(' ', value)}\r\n" for name, value in headers.items() if value is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


_LINE_ENDS = re.compile(r"[\r\n]+")


class Packer:
    """Gzip members put together to archives of at most ``most_bytes`` before compression, or of one larger record, and of at most ``most_records``."""

    def __init__(self, most_bytes: int, most_records: int):
        self.most_bytes, self.most_records = most_bytes, most_records
        self.held, self.room = [], 0

    def add(self, member: bytes, size: int) -> Iterator[bytes]:
        """The archive that ends before a record of ``size`` bytes, if one does."""
        if self.held and (self.room + size > self.most_bytes or len(self.held) == self.most_records):
            yield from self.close()
        self.held.append(member)
        self.room += size

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield BETWEEN.join(self.held)
            self.held, self.room = [], 0


def write_archives(records: DataFrame, path: str, *, records_per_archive: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``resolve_revisits`` records, each with fresh headers, as archives named ``*.warc.gz`` to the new folder ``path``.

    Null headers are left out and a null payload is empty; an empty table gives a folder without archives. It is one pass
    over ``records``: a task hands each archive to Spark's text writer as a row, and the writer begins a file with each. An archive
    holds records of at most ``archive_bytes`` before compression, or one record that is larger, and at most ``records_per_archive``.
    Spark names the finished files ``*.txt``; the driver renames them, many at a time.
    """
    names = [field.split()[0] for field in _RECORD_SCHEMA.split(", ")]

    def archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(archive_bytes, records_per_archive)
        for frame in frames:
            for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None):
                record = record_bytes(dict(zip(names, row, strict=True)))
                for archive in packer.add(gzip.compress(record, LEVEL, mtime=0), len(record)):
                    yield pd.DataFrame({"archive": [archive]})
        yield pd.DataFrame({"archive": list(packer.close())})

    as_text = [F.col(c).cast("string").alias(c) if c in ("record_id", "refers_to") else F.col(c) for c in names]  # pandas would turn nulls into floats
    packed = records.select(*as_text).mapInPandas(archives, "archive binary")
    writer = packed.select(F.col("archive").cast("string").alias("value")).write
    writer.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)
    _rename(records.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Spark names its text files ``*.txt``; they become ``*.warc.gz``, ``RENAMED_AT_ONCE`` at a time."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [name for status in store.listStatus(folder) if (name := status.getPath().getName()).endswith(".txt")]

    def rename(name: str) -> None:
        store.rename(jvm.org.apache.hadoop.fs.Path(folder, name), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))

    with ThreadPoolExecutor(RENAMED_AT_ONCE) as pool:
        list(pool.map(rename, names))


class _Gunzip(io.RawIOBase):
    """Bytes of a gzip file of one or more members, unpacked as they are read."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.unpack = memoryview(packed), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            source = self.unpack.unconsumed_tail
            if not source:
                source = self.packed[self.at : self.at + (1 << 16)]
                self.at += len(source)
                if not source:
                    return 0
            data = self.unpack.decompress(source, len(buffer))
            if self.unpack.eof:
                self.at -= len(self.unpack.unused_data)
                self.unpack = zlib.decompressobj(31)
            if data:
                buffer[: len(data)] = data
                return len(data)


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    """Up to and with the empty line; names in lower case."""
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def parse_archive(packed: bytes) -> Iterator[tuple]:
    """The response and revisit records of an archive, in order. A payload that does not match its SHA-1 is an error."""
    stream = io.BufferedReader(_Gunzip(packed), 1 << 16)
    own = re.compile(re.escape(_NAME) + r"(-?\d+)?")

    def name(value: str | None) -> tuple[int | None, str | None]:
        """The number of a name that :func:`write_archives` has made up, or else the name."""
        bare = (value or "").strip("<>")
        return (int(m[1]) if m[1] else None, None) if (m := own.fullmatch(bare)) else (None, bare or None)

    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"a record begins with {line[:40]!r}")
            continue
        head = _headers(stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        block.readline()
        http = _headers(block)
        payload = block.read() if kind == "response" else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if payload is not None and _hexadecimal(digest) != (found := hashlib.sha1(payload).hexdigest()):
            if digest:
                raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
            digest = found
        size = len(payload) if payload is not None else int(http.get("content-length", 0))
        refers = name(head.get("warc-refers-to"))
        yield (*name(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-date"), kind, *refers, head.get("warc-refers-to-target-uri"), head.get("warc-refers-to-date"), size, _hexadecimal(digest), payload)


def _hexadecimal(digest: str) -> str:
    """Other writers give SHA-1 in base 32."""
    return base64.b32decode(digest).hex() if len(digest) == 32 and digest.isupper() else digest


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The records of all archives ``*.gz`` below ``path``: names, types, digests, lengths and, if wanted, payloads (null for revisits).

    ``record_id`` and ``refers_to`` are the numbers that :func:`write_archives` has named records by; other names are in
    ``record_name`` and ``refers_to_name``. Missing headers are null. A folder without archives gives no rows.
    """
    names = [f.split()[0] for f in _RECORD_SCHEMA.split(", ")][: None if with_payload else -1]
    schema = _RECORD_SCHEMA if with_payload else _RECORD_SCHEMA.rpartition(", ")[0]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for packed in frame["content"]:
                rows: list[tuple] = []
                room = 0
                for record in parse_archive(packed):
                    rows.append(record[: len(names)])
                    room += record[9]
                    if room > 1 << 24 or len(rows) >= 10_000:
                        yield _frame(rows, names)
                        rows, room = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"record_id": "Int64", "refers_to": "Int64"})


def deduplicated_archives(spark: SparkSession, source: str, target: str, *, min_bytes: int = 1000) -> None:
    """Read the archives below ``source`` and write them to ``target`` with repeated payloads as revisits. Links of revisits
    to responses in other archives stay. The HTTP headers of responses are written afresh. Missing headers stay missing; a
    ``source`` without archives gives a ``target`` without archives."""
    write_archives(resolve_revisits(read_archives(spark, source), min_bytes=min_bytes), target)
