"""WARC archives as a Python data source for Spark, for reading and writing.

Writing: `plan_revisits` finds payloads that occur more than once; the record with the
largest id is the response, the others are revisits that name it and carry no payload. Tasks
write archives of bounded size under names of their own, and a manifest that is written at
commit names those that count, so archives of lost or repeated tasks are never read.

Each record is a gzip member of its own. Its length stands in an extra field of the member's
header, which other readers skip; with it a record that is not wanted is passed by without
inflating it. Archives from elsewhere, plain or gzipped, are read as well; where the field
is missing a gzip member is inflated to find its end.

Reading: partitions are planned from the manifest (or the folder's list), archives packed up
to a size. Filters on record type and header fields are pushed down to the source. Of each
record the header is parsed first; the payload is inflated and decoded only if the header
passes and payloads are asked for (option ``payload``).
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
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

from gleanery.llm.token_files import opened
from gleanery.llm.words import whole
from gleanery.session import freeze_table

FORMAT = "gleanery_warc"
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, date string, "
    "payload_digest string, payload_bytes long, payload binary"
)
# Header fields behind the columns that filters can be pushed on.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "date": "warc-date",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_archives"  # begin of the names of manifests, one for each commit
ARCHIVE_BYTES = 32 << 20
SPLIT_BYTES = 32 << 20
HEADER_BYTES = 16 << 10
LEAST_REVISIT = 1000
DATE = "2024-01-04T00:00:00Z"
OUTPUT_BYTES = 8 << 20
_URI_SAFE = "".join(chr(c) for c in range(33, 127))


# Records ------------------------------------------------------------------------------


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member whose extra field SL tells its length and that of ``data``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"".join((head, body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)))


def record(row: dict, date: str = DATE) -> bytes:
    """One response or revisit record with its HTTP header; ``row`` has the writer's columns."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}",
    ]
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=_URI_SAFE)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name; continuation lines are joined."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon and name not in fields:
            fields[name] = value.strip()
    for key in ("warc-record-id", "warc-refers-to"):
        if key in fields:
            fields[key] = fields[key].removeprefix("<").removesuffix(">")
    return fields


def hex_digest(value: str | None) -> str | None:
    """A ``sha1:`` digest in base 32 or base 16 as lower-case hexadecimal."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(digest) == 40:
        return digest.lower()
    try:
        return base64.b32decode(digest.upper()).hex()
    except ValueError:
        return None


class _Plain:
    """A record's bytes in an archive that is not compressed."""

    def __init__(self, file: pa.NativeFile, at: int, first: bytes):
        self.file, self.at, self.data = file, at, first

    def upto(self, size: int) -> bytes:
        if len(self.data) < size:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(size - len(self.data))
        return self.data[:size]

    def end(self, size: int) -> int:
        return self.at + size


class _Member:
    """A record's bytes in a gzip member; only as much is inflated as is asked for."""

    def __init__(self, file: pa.NativeFile, at: int, first: bytes):
        self.file, self.at = file, at
        self.data, self.total = b"", None
        flags, place = first[3], 10
        if flags & 4:
            (extra,) = struct.unpack_from("<H", first, place)
            fields, stop, place = place + 2, place + 2 + extra, place + 2 + extra
            while fields + 4 <= stop:
                name, size = struct.unpack_from("<2sH", first, fields)
                if name == b"SL" and size == 8:
                    total, plain = struct.unpack_from("<II", first, fields + 4)
                    # Lengths are kept modulo 2**32; larger ones are not relied on.
                    self.total = total if plain < 1 << 31 and total < 1 << 31 else None
                fields += 4 + size
        for flag in (8, 16):
            if flags & flag:
                place = first.index(b"\0", place) + 1
        place += 2 if flags & 2 else 0
        self.inflate = zlib.decompressobj(-15)
        self.waiting, self.read_to = first[place:], at + len(first)

    def _more(self, size: int) -> bool:
        if self.inflate.eof:
            return False
        if not self.waiting:
            self.file.seek(self.read_to)
            self.waiting = self.file.read(1 << 20)
            self.read_to += len(self.waiting)
            if not self.waiting:
                raise ValueError(f"gzip member at {self.at} is cut short")
        self.data += self.inflate.decompress(self.waiting, size)
        self.waiting = self.inflate.unconsumed_tail
        return True

    def upto(self, size: int) -> bytes:
        while len(self.data) < size and self._more(size - len(self.data)):
            pass
        return self.data[:size]

    def end(self, size: int) -> int:
        if self.total is not None:
            return self.at + self.total
        while not self.inflate.eof:
            self.data = b""
            self._more(1 << 20)
        return self.read_to - len(self.inflate.unused_data) + 8


def read_records(file: pa.NativeFile, size: int, passes, with_payload: bool) -> Iterator[tuple]:
    """Rows of one archive. ``passes`` judges a record by its header fields alone."""
    at = 0
    while at < size:
        file.seek(at)
        first = file.read(HEADER_BYTES)
        if not first.strip(b"\r\n\0"):
            at += len(first)
            continue
        source = (_Member if first[:2] == b"\x1f\x8b" else _Plain)(file, at, first)
        want, cut = HEADER_BYTES // 4, -1
        while cut < 0:
            data = source.upto(want)
            cut = data.find(b"\r\n\r\n")
            if cut < 0 and len(data) < want:
                raise ValueError(f"no WARC header at {at}")
            want *= 2
        if not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = header_fields(data[:cut])
        start, length = cut + 4, int(fields.get("content-length", 0))
        if passes(fields):
            yield _row(source, fields, start, length, with_payload)
        at = source.end(start + length + 4)


def _row(source, fields: dict[str, str], start: int, length: int, with_payload: bool) -> tuple:
    body, payload_bytes = start, length
    if fields.get("content-type", "").startswith("application/http"):
        want, cut = min(length, 4096), -1
        while cut < 0:
            head = source.upto(start + want)[start:]
            cut = head.find(b"\r\n\r\n")
            if want >= length:
                break
            want = min(length, want * 4)
        if cut >= 0:
            body = start + cut + 4
            told = header_fields(head[:cut]).get("content-length", "")
            payload_bytes = int(told) if told.isdigit() else length - cut - 4
    revisit = fields.get("warc-type") == "revisit"
    payload = source.upto(start + length)[body:] if with_payload and not revisit else None
    return (
        *(fields.get(FIELDS[c]) for c in ("record_id", "record_type", "target_uri", "refers_to", "date")),
        hex_digest(fields.get("warc-payload-digest")),
        payload_bytes,
        payload,
    )


# Data source --------------------------------------------------------------------------


@dataclass
class Archives(InputPartition):
    """Archives that one task reads, with their sizes."""

    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]  # name, bytes, records


def _test(item: Filter):
    """A header test for a filter, or None where the source can't apply it."""
    if not hasattr(item, "attribute") or len(item.attribute) != 1 or item.attribute[0] not in FIELDS:
        return None
    field = FIELDS[item.attribute[0]]
    if isinstance(item, (EqualTo, EqualNullSafe)):
        return lambda fields: fields.get(field) == item.value
    if isinstance(item, In):
        values = set(item.value)
        return lambda fields: fields.get(field) in values
    if isinstance(item, IsNotNull):
        return lambda fields: field in fields
    if isinstance(item, IsNull):
        return lambda fields: field not in fields
    if isinstance(item, StringStartsWith):
        return lambda fields: fields.get(field, "").startswith(item.value)
    return None


def manifests(store: pafs.FileSystem, root: str) -> list[str]:
    """Paths of the manifests of all commits to a folder."""
    listed = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in listed if i.is_file and i.base_name.startswith(MANIFEST) and i.extension == "json")


def listed_in(store: pafs.FileSystem, path: str) -> list[tuple[str, int, int]]:
    with store.open_input_file(path) as file:
        return [tuple(entry) for entry in json.loads(file.read())]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for item in filters:
            if _test(item) is None:
                yield item
            else:
                self.filters.append(item)

    def partitions(self) -> list[Archives]:
        store, root = opened(self.folder)
        told = manifests(store, root)
        if told:
            found = [(name, size) for path in told for name, size, _ in listed_in(store, path)]
        else:
            listed = store.get_file_info(pafs.FileSelector(root, recursive=True))
            found = [
                (info.path[len(root) :].lstrip("/"), info.size)
                for info in listed
                if info.is_file and info.path.endswith((".warc", ".warc.gz"))
            ]
        plans, room = [], 0
        for name, size in sorted(found, key=lambda f: (-f[1], f[0])):
            if not plans or size > room:
                plans.append(Archives([]))
                room = self.split_bytes
            plans[-1].files.append((name, size))
            room -= size
        return plans or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.folder)
        tests = [_test(f) for f in self.filters]
        schema = _arrow_schema()
        rows, held = [], 0
        for name, size in partition.files:
            with store.open_input_file(f"{root}/{name}") as file:
                for row in read_records(file, size, lambda fields: all(t(fields) for t in tests), self.with_payload):
                    rows.append(row)
                    held += 300 + len(row[-1] or b"")
                    if held >= OUTPUT_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _arrow_schema() -> pa.Schema:
    text = [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "date", "payload_digest")]
    return pa.schema([*text, ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    """Archives count once a manifest names them. An append adds a manifest of its own; an
    overwrite drops the earlier ones, and their archives, after its own is in place."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.folder = options["path"]
        self.overwrite = overwrite
        self.archive_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))
        self.level = int(options.get("level", 1))
        self.date = options.get("date", DATE)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        files, out, name, size, count = [], None, "", 0, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    data = member(record(row, self.date), self.level)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= self.archive_bytes:
                        out.close()
                        files.append((name, size, count))
                        out = None
        if out is not None:
            out.close()
            files.append((name, size, count))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        earlier = manifests(store, root) if self.overwrite else []
        path = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        # Under its name only when it is whole: a driver that dies here leaves nothing to read.
        with store.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{path}.part", f"{path}.json")
        dropped = [name for old in earlier for name, _, _ in listed_in(store, old)]
        for old in earlier:
            store.delete_file(old)
        for name in dropped:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.folder)
        for message in messages:
            for name, _, _ in message.files if message is not None else []:
                store.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("gleanery_warc").load(folder)``; options path, payload, split_bytes,
    and for writing archive_bytes, level, date."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, with push-down into Python data sources switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# Pages --------------------------------------------------------------------------------


def plan_revisits(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least: int = LEAST_REVISIT,
) -> DataFrame:
    """A row of writer columns per page: response, or revisit of the page with equal payload
    and the largest id. Payloads below ``least`` bytes are always responses, as are rows that
    repeat the largest id and payloads of which no row has an id. A missing payload is empty.
    """
    payload = whole(payload_column).cast("binary")
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col(url_column).alias("target_uri"), payload.alias("payload")
    ).withColumns({"_key": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # Roles are found on ids and keys alone and are few rows without texts. They are written, so
    # that their size is known: small ones are broadcast and no payload moves, else a payload
    # moves once, dealt by key and id, so that the copies of one text are spread.
    named = freeze_table(rows.filter(F.col("payload_bytes") >= least).select("_key", "_id"), "payload-keys")
    groups = named.groupBy("_key").agg(F.max("_id").alias("_kept"), F.count("*").alias("_n")).filter("_n > 1")
    copies = named.distinct().join(groups.drop("_n"), "_key").filter(~F.col("_id").eqNullSafe(F.col("_kept")))
    copies = copies.filter("_kept is not null").withColumnsRenamed({"_key": "_of", "_id": "_copy"})
    copies = freeze_table(copies, "revisits")
    same = (F.col("_key") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_copy"))
    joined = rows.join(copies, same, "left")
    again = F.col("_kept").isNotNull()

    def urn(column):
        missing = F.concat(F.lit("none-"), "_key")
        return F.concat(F.lit("urn:gleanery:page:"), F.coalesce(F.col(column).cast("string"), missing))

    return joined.select(
        urn("_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn("_kept")).alias("refers_to"),
        F.lit(DATE).alias("date"),
        F.sha1("payload").alias("payload_digest"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, folder: str, **columns) -> None:
    register(pages.sparkSession)
    plan_revisits(pages, **columns).write.format(FORMAT).mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(folder)
