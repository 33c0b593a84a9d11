"""WARC archives as a Spark data source, read and written.

Reading: each archive file is a partition. Predicates on record type and other header columns are pushed
down: a task parses a record's headers first and passes over an unwanted record without decoding
its payload. In a gzipped archive every record is a member of its own; members written here
carry their compressed length in the extra field ``SL``, so the rest of an unwanted member is not even inflated. With
the option ``payload=false`` no payload is decoded; its length comes from the HTTP head.

Writing: every task writes files of its own under a temporary name and the driver renames those of
the attempts that committed, so a lost or repeated task leaves no records twice. Paths may be
of any file system that pyarrow opens by URI.

Of records with equal payloads the one with the smallest id is a ``response``, and the others are
``revisit`` records that refer to it and hold no payload. This is decided on ids and digests alone; payloads are not shuffled
while the repeated digests are few enough for a broadcast (``MOST_BROADCAST`` rows).

Ids stand percent-encoded in the records' URNs and come back as they were. White space and control characters in URLs are percent-encoded, as
a URL must not hold them, and stay so.

Defined cases: a null payload is empty; a null URL gives no target header; a null id is never the smallest
unless all of a group's ids are null, and then all are responses; a repeated row of the smallest id is a response
too; empty tables give an empty archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..sources.folders import scratch
from .cluster import cut

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
HEADERS = {
    "record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "date": b"warc-date",
    "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest",
}
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 64 << 10  # longest HTTP head that is looked for
MOST_BROADCAST = 200_000  # repeated digests, about 100 bytes each


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path.removeprefix("file:")


# --- records ---------------------------------------------------------------------------------------------------------


def headers_of(block: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name; a continued line is joined to its field."""
    found: dict[bytes, bytes] = {}
    name = b""
    for line in block.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            found[name] = (found[name] + b" " + line.strip()).strip()
            continue
        name, colon, value = line.partition(b":")
        if colon:
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Member:
    """One gzip member of an archive, inflated as far as is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        head = file.read(12)
        self.length = None
        if head[:2] == b"\x1f\x8b" and head[3] & 4:
            extra = file.read(struct.unpack("<H", head[10:12])[0])
            if extra[:4] == b"SL\x08\x00":
                self.length = struct.unpack("<I", extra[4:8])[0]
        file.seek(at)
        self.inflate = zlib.decompressobj(31)
        self.pending = b""

    def read(self, most: int) -> bytes:
        if self.inflate.eof:
            return b""
        data = self.pending or self.file.read(min(1 << 16, max(most, 1 << 10)))
        out = self.inflate.decompress(data, most)
        self.pending = self.inflate.unconsumed_tail
        if not out and not self.inflate.eof and data:
            return self.read(most)
        return out

    def end(self) -> int:
        """Where the next member begins."""
        if self.length is not None:
            return self.at + self.length
        while not self.inflate.eof and self.read(1 << 16):
            pass
        return self.file.tell() - len(self.inflate.unused_data) - len(self.pending)


def records(file, size: int, wanted, decode: bool) -> Iterator[tuple[dict[bytes, bytes], bytes | None, bool]]:
    """(headers, block, whether its payload was passed over) of each record of an archive of ``size`` bytes.

    The block of a wanted record is whole, or with ``decode`` off begins with its HTTP head; that of others is None.
    """
    at = 0
    file.seek(0)
    zipped = file.read(2) == b"\x1f\x8b"
    while at < size:
        if zipped:
            member = Member(file, at)
            source = member.read
        else:
            file.seek(at)
            source = file.read
        head = b""
        while b"\r\n\r\n" not in head:
            more = source(1 << 10)
            if not more:
                break
            head += more
        block, found, rest = head.partition(b"\r\n\r\n")
        if not found:
            if head.strip():
                raise ValueError(f"no record at byte {at}")
            return
        own = headers_of(block.lstrip(b"\r\n"))
        length = int(own.get(b"content-length", b"0"))
        body = None
        if wanted(own):
            parts, have = [rest], len(rest)
            while have < length and (decode or (have < HEAD_BYTES and b"\r\n\r\n" not in b"".join(parts))):
                more = source(length - have if decode else 1 << 10)
                if not more:
                    raise ValueError(f"a record at byte {at} is cut short")
                parts.append(more)
                have += len(more)
            body = b"".join(parts)[:length]
        yield own, body, body is None or not decode
        at = member.end() if zipped else at + len(block) + 4 + length + 4


def packed(record: bytes) -> bytes:
    """A record as a gzip member that names its own compressed length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    extra = b"SL\x08\x00" + struct.pack("<II", 12 + 12 + len(body) + 8, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


_URIS = {"WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To"}


def uri(value: str) -> str:
    """A URI with its white space and control characters percent-encoded."""
    return re.sub(r"[\s\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(row: dict) -> bytes:
    """The bytes of a response or revisit record; a revisit keeps the HTTP head of the payload it leaves out."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"]
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date")), ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Payload-Digest", row.get("payload_digest")), ("WARC-Refers-To", row.get("refers_to")),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    plain = lambda k, v: uri(str(v)) if k in _URIS else " ".join(str(v).split())
    lines = [f"{k}: {plain(k, v)}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


# --- the data source -------------------------------------------------------------------------------------------------


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, overwrite)


@dataclass
class Archive(InputPartition):
    path: str
    size: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() != "false"
        self.pushed: list[tuple[str, str, object]] = []
        self.passed_over = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)):
                self.pushed.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, path = file_system(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pa.fs.FileType.Directory else [fs.get_file_info(path)]
        return [Archive(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]

    def wanted(self, headers: dict[bytes, bytes]) -> bool:
        for kind, column, value in self.pushed:
            own = headers.get(HEADERS[column])
            own = own.decode("utf-8", "replace") if own is not None else None
            if kind == "IsNull":
                ok = own is None
            elif kind == "IsNotNull":
                ok = own is not None
            elif own is None:
                ok = False
            elif kind == "In":
                ok = own in value
            else:
                ok = own == value if kind == "EqualTo" else own.startswith(value)
            if not ok:
                return False
        return True

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = file_system(self.path)
        names = [*HEADERS, "payload_length", "payload"]
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for headers, block, passed in records(file, partition.size, self.wanted, self.decode):
                self.passed_over += passed
                if block is None:
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                length = headers_of(http).get(b"content-length")
                if not self.decode or headers.get(HEADERS["record_type"]) == b"revisit":
                    payload = None
                length = int(length) if length is not None and payload is None else len(payload) if payload is not None else None
                rows.append([*((headers[h].decode("utf-8", "replace") if h in headers else None) for h in HEADERS.values()), length, payload])
                held += 500 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        own, files, file, size = uuid.uuid4().hex, [], None, 0
        fs.create_dir(f"{path}/_{self.job}", recursive=True)
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if file is None or size >= FILE_BYTES:
                        if file is not None:
                            file.close()
                        files.append(f"{own}-{len(files):04d}.warc.gz")
                        file, size = fs.open_output_stream(f"{path}/_{self.job}/{files[-1]}", compression=None), 0
                    data = packed(record(batch.slice(i, 1).to_pylist()[0]))
                    file.write(data)
                    size += len(data)
        finally:
            if file is not None:
                file.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pa.fs.FileSelector(path)):
                if f.is_file:
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.files if m is not None else ():
                fs.move(f"{path}/_{self.job}/{name}", f"{path}/{name}")
        if fs.get_file_info(f"{path}/_{self.job}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        if fs.get_file_info(f"{path}/_{self.job}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_{self.job}")


def read(spark, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# --- pages to archives and back --------------------------------------------------------------------------------------


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex digest of a multiple of 20 bits, five hex digits at a time."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(value: Column) -> Column:
    """The record id of a page id; null has one of its own."""
    return F.coalesce(F.concat(F.lit("<urn:x-page:"), F.url_encode(value.cast("string")), F.lit(">")), F.lit("<urn:x-page>"))


def page_of(value: str, kind) -> Column:
    """The page id of a record id."""
    return F.when(F.col(value).startswith("<urn:x-page:"), F.url_decode(F.regexp_extract(value, "^<urn:x-page:(.*)>$", 1))).cast(kind)


def to_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records to write: one for each page."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    small = pages.select(F.col(page_id).alias("id_"), F.sha1(body).alias("sha1_"))
    first = cut(small.groupBy(F.col("sha1_").alias("digest_")).agg(F.min("id_").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").select("digest_", "first_"))
    rows = pages.select(F.col(page_id).alias("id_"), F.col(url).alias("url_"), body.alias("payload")).withColumn("sha1_", F.sha1("payload"))
    if first.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(first), F.col("sha1_") == F.col("digest_"), "left")
    else:  # by id and digest, so that no payload is met by many others
        again = small.join(first, F.col("sha1_") == F.col("digest_")).select(F.col("id_").alias("again_"), "digest_", "first_").distinct()
        rows = rows.join(again, (F.col("sha1_") == F.col("digest_")) & F.col("id_").eqNullSafe(F.col("again_")), "left")
    revisit = F.col("first_").isNotNull() & ~F.col("id_").eqNullSafe(F.col("first_"))
    return rows.select(
        urn(F.col("id_")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url_").alias("target_uri"),
        F.lit("2020-01-01T00:00:00Z").alias("date"), F.when(revisit, urn(F.col("first_"))).alias("refers_to"), F.concat(F.lit("sha1:"), base32(F.col("sha1_"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(Warc)
    rows.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives written to a new folder in the shared one and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Responses are read with their payload, of which the digest is taken anew; revisits by their headers alone.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(to_records(pages, page_id, url, html), path)
    kind = pages.schema[page_id].dataType
    responses = read(spark, path).where("record_type = 'response'").withColumn("digest", base32(F.sha1("payload")))
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'").withColumn("digest", F.regexp_replace("payload_digest", "^sha1:", ""))
    columns = [page_of("record_id", kind).alias(page_id), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page_of("refers_to", kind).alias("refers_to"), "target_uri"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
