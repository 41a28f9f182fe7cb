"""WARC archives as a Spark data source, written and read, with duplicate payloads as revisits (operator 11).

``spark.read.format("warc")`` plans partitions over whole files: small ones share a partition up to ``partitionBytes``, a filter on ``file``
leaves files out before any is opened. Filters on the record type and the other header columns are pushed into the source. A reader parses a
record's headers first; where a pushed filter turns the record down, or the schema asked for has no ``payload``, the block is not
decoded: in a plain archive it is passed by its Content-Length, in a compressed one by the skip length that the writer leaves in the
extra field of each gzip member ("sl"; members without it are inflated piecewise and dropped). So a reader holds one record at most.

``df.write.format("warc")`` has each task write files of its own, a new one once ``fileBytes`` are reached; the list of the files of the
tasks that succeeded is written last, and readers go by it: files of lost or doubled tasks are never seen. A folder without
that list is read whole. Paths are what ``pyarrow.fs`` knows: local or mounted paths and the URIs of object stores and HDFS.

Duplicates: payloads are grouped by their SHA-256, counted before the shuffle. Only digests of two or more rows are joined back;
Spark broadcasts them where their size allows, and splits a digest with many rows (adaptive skew join) where it does not.

Defined cases: a null payload is empty; payloads below ``LEAST`` bytes are responses always; of equal payloads the rows with the smallest
page_id are responses (rows that repeat this page_id too) and the others, those without a page_id included, are
revisits; where all page_ids are null, all are responses; a null URL has no header, control characters in one are percent-encoded; long
payloads are written whole; an empty table gives an archive without records and an empty result; other columns are ignored. A damaged
archive fails the read and names the file and the place.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import durable, shared_dir, table

LEAST = 100  # bytes below which equal payloads are no duplicates
LIST = "_files.json"
SCHEMA = "page_id long, record_id string, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string"
WRITTEN = ("page_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
_END, _BATCH_BYTES, _BATCH_ROWS, _CHUNK = b"\r\n\r\n", 8 << 20, 4096, 1 << 16


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+:/", path) else (pa.fs.LocalFileSystem(), path)


# ---- records ----


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def encoded(page_id: int | None, kind: str, uri: str | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """A record: a response has its payload behind the HTTP headers, a revisit these headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    headers = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        plain = re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", uri)
        headers.append("WARC-Target-URI: " + plain)
    headers.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        headers.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + _END + block + _END


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field states its own length and the record's."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    whole = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parsed(head: bytes) -> dict[str, str]:
    """Header fields in lower case; folded lines are joined, the first of repeated fields counts."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    found: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        found.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return found


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("-?[0-9]+", text) else None


def columns_of(fields: dict[str, str], file: str) -> dict:
    """What the headers alone say. The size of a revisit's payload stands in its HTTP headers, which count as its block."""
    return {
        "page_id": _whole(fields.get("page-id")), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": _whole(fields.get("refers-to-page-id")), "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "file": file,
    }


def parted(block: bytes, http: bool) -> tuple[int, bytes]:
    """Size of the payload, and the payload, of a block with or without HTTP headers in front."""
    if not http:
        return len(block), block
    head, gap, body = block.partition(_END)
    stated = re.search(rb"(?i)\ncontent-length:[ \t]*([0-9]+)", head)
    return (int(stated[1]) if stated and not body else len(body)) if gap else len(block), body if gap else block


class Archive:
    """Records of one open archive: ``next`` gives the headers, then ``block`` or the call after it decides whether the rest is decoded."""

    def __init__(self, source, name: str) -> None:
        self.source, self.name, self.at = source, name, 0
        self.decoded = 0  # bytes of blocks that were decoded

    def _fail(self, why: str) -> ValueError:
        return ValueError(f"{self.name} at byte {self.at}: {why}")

    def records(self, wanted: Callable[[dict[str, str]], bool]) -> Iterator[tuple[dict[str, str], Callable[[int | None], bytes]]]:
        """(fields, block) of the wanted records. ``block(n)`` decodes the first ``n`` bytes of the block, all for None."""
        while True:
            self.source.seek(self.at)
            start = self.source.read(24)
            if not start:
                return
            read, end = self._member(start) if start[:2] == b"\x1f\x8b" else self._plain()
            head = b""
            while _END not in head:
                more = read(4096)
                if not more:
                    raise self._fail("headers without an end")
                head += more
            head, _, rest = head.partition(_END)
            try:
                fields = parsed(head)
                size = int(fields["content-length"])
            except (ValueError, KeyError) as e:
                raise self._fail(str(e)) from e
            taken = [rest]

            def block(n: int | None = None, taken=taken, read=read, size=size) -> bytes:
                want = size if n is None else min(n, size)
                have = sum(map(len, taken))
                while have < want:
                    more = read(want - have)
                    if not more:
                        raise self._fail("a block that ends early")
                    taken.append(more)
                    have += len(more)
                taken[:] = [b"".join(taken)]
                self.decoded += want
                return taken[0][:want]

            if wanted(fields):
                yield fields, block
            self.at = end(len(head) + 4 + size + 4)

    def _plain(self):
        self.source.seek(self.at)
        return self.source.read, lambda length: self.at + length

    def _member(self, start: bytes):
        inflate = zlib.decompressobj(31)
        stated = struct.unpack("<I", start[16:20])[0] if start[3] == 4 and start[10:16] == struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) else 0
        begin, pos = self.at, [self.at]

        def read(n: int) -> bytes:
            out = b""
            while not out and not inflate.eof:
                if inflate.unconsumed_tail:
                    raw = inflate.unconsumed_tail
                else:
                    self.source.seek(pos[0])
                    raw = self.source.read(min(_CHUNK, stated - (pos[0] - begin)) if stated else _CHUNK)
                    pos[0] += len(raw)
                    if not raw:
                        raise self._fail("a gzip member that ends early")
                try:
                    out = inflate.decompress(raw, max(n, 1))
                except zlib.error as e:
                    raise self._fail(str(e)) from e
            return out

        def end(_: int) -> int:
            if stated:
                return begin + stated
            while not inflate.eof:
                read(_CHUNK)
            return pos[0] - len(inflate.unused_data)

        return read, end


# ---- filters ----


def test_of(filter) -> Callable[[dict], bool] | None:
    """A predicate over ``columns_of`` that says what Spark's filter says, or None where the source has none."""
    if isinstance(filter, Not):
        inner = test_of(filter.child)
        column = getattr(filter.child, "attribute", (None,))[0]
        if inner is None or isinstance(filter.child, Not):
            return None
        nulls = isinstance(filter.child, (IsNull, IsNotNull, EqualNullSafe))
        return lambda row: (nulls or row[column] is not None) and not inner(row)
    if len(filter.attribute) != 1 or filter.attribute[0] not in {"page_id", "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "file"}:
        return None
    name, value = filter.attribute[0], getattr(filter, "value", None)
    given = lambda check: lambda row: row[name] is not None and check(row[name])
    known: dict[type, Callable] = {
        EqualTo: lambda: given(lambda x: x == value), EqualNullSafe: lambda: lambda row: row[name] == value, In: lambda: given(lambda x: x in filter.value),
        GreaterThan: lambda: given(lambda x: x > value), GreaterThanOrEqual: lambda: given(lambda x: x >= value), LessThan: lambda: given(lambda x: x < value), LessThanOrEqual: lambda: given(lambda x: x <= value),
        IsNull: lambda: lambda row: row[name] is None, IsNotNull: lambda: given(lambda x: True),
        StringStartsWith: lambda: given(lambda x: x.startswith(value)), StringEndsWith: lambda: given(lambda x: x.endswith(value)), StringContains: lambda: given(lambda x: value in x),
    }
    make = known.get(type(filter))
    return make() if make else None


# ---- the source ----


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: CaseInsensitiveDict) -> None:
        self.names, self.path = schema.names, options["path"]
        self.arrow = [(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields]
        self.target, self.pushed = int(options.get("partitionBytes", 64 << 20)), []

    def pushFilters(self, filters):
        for f in filters:
            if test_of(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def _keeps(self, row: dict) -> bool:
        return all(t(row) for t in self.tests)

    def partitions(self) -> list[Files]:
        """Files in order, so many to a partition as fit; a file of any size is one task's."""
        fs, root = _store(self.path)
        listed = f"{root}/{LIST}"
        if fs.get_file_info(listed).type == pa.fs.FileType.File:
            with fs.open_input_stream(listed) as f:
                sizes = {name: size for name, size in json.loads(f.read())}
        else:
            infos = fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pa.fs.FileType.Directory else [fs.get_file_info(root)]
            sizes = {i.path.removeprefix(root).lstrip("/"): i.size for i in infos if i.type == pa.fs.FileType.File and not i.base_name.startswith(("_", "."))}
        of_file = [test_of(f) for f in self.pushed if getattr(f, "attribute", None) == ("file",)]
        groups: list[Files] = []
        room = 0
        for name in sorted(n for n in sizes if all(t({"file": n}) for t in of_file)):
            if not groups or room < sizes[name]:
                groups.append(Files([]))
                room = self.target
            groups[-1].names.append(name)
            room -= sizes[name]
        return groups

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        self.tests = [test_of(f) for f in self.pushed]
        fs, root = _store(self.path)
        payload, sized = "payload" in self.names, "payload_bytes" in self.names
        rows: list[dict] = []
        held = 0
        for name in partition.names if partition else []:
            with fs.open_input_file(f"{root}/{name}" if name else root) as raw:
                archive = Archive(io.BufferedReader(raw, 1 << 20), name)
                for fields, block in archive.records(lambda fields: self._keeps(columns_of(fields, name))):  # noqa: B023
                    row = columns_of(fields, name)
                    if payload or sized:
                        http, length = fields.get("content-type", "").startswith("application/http"), int(fields["content-length"])
                        if payload:
                            row["payload_bytes"], row["payload"] = parted(block(None), http)
                            if row["record_type"] == "revisit":
                                row["payload"] = None
                        else:  # the HTTP headers are enough to tell the size
                            front = block(4096) if http else b""
                            if http and _END not in front and length > len(front):
                                front = block(None)
                            body = length - (len(front.partition(_END)[0]) + 4 if _END in front else 0)
                            row["payload_bytes"] = body if body else parted(front, http)[0] if http else length
                        held += len(row.get("payload") or b"")
                    rows.append(row)
                    if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in self.arrow], names=[n for n, _ in self.arrow])


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


@dataclass
class Done(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: CaseInsensitiveDict) -> None:
        if missing := [c for c in WRITTEN if c not in schema.names]:
            raise ValueError(f"a WARC archive is written from the columns {', '.join(WRITTEN)}; missing: {', '.join(missing)}")
        self.path, self.bytes, self.level = options["path"], int(options.get("fileBytes", 128 << 20)), int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        part, files, out, size = TaskContext.get().partitionId(), [], None, 0
        for batch in iterator:
            for row in zip(*[batch.column(batch.schema.get_field_index(c)) for c in WRITTEN]):
                page, kind, uri, refers, digest, length, payload = (x.as_py() for x in row)
                record = encoded(page, kind, uri, refers, digest, length, payload or b"")
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc" + (".gz" if self.level else "")
                    out, size = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20, compression=None), 0
                data = member(record, self.level) if self.level else record
                out.write(data)
                size += len(data)
                if size >= self.bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Done(files)

    def commit(self, messages: list[Done | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps([file for m in messages if m for file in m.files]).encode())

    def abort(self, messages: list[Done | None]) -> None:
        fs, root = _store(self.path)
        for name, _ in (file for m in messages if m for file in m.files):
            fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: ``path``; for reading ``partitionBytes``; for writing ``fileBytes`` and ``level`` (of gzip, 0 for plain archives)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    """Records of an archive; columns outside ``schema`` are not decoded."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write(records: DataFrame, path: str, **options: str) -> None:
    """Archive records with the columns ``WRITTEN``, into a new folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*WRITTEN).write.format("warc").options(**options).mode("append").save(path)


def told(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The columns ``WRITTEN`` of pages (page_id, url, html): each a response, or a revisit of the page that has its payload first."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = durable(firsts.where("n > 1 and first is not null").select("payload_digest", "first"), "first-pages")
    met = rows.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    met = met.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first")), "payload": F.when(~again, F.col("payload"))})
    return met.select(*WRITTEN)


def op11_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it stands in the archive written from ``pages``: responses by their decoded payloads, revisits by their headers."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(told(table(spark, sf_dir, "pages")), path)
    whole = read(spark, path).where("record_type = 'response'")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    heads = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return whole.unionByName(read(spark, path, heads).where("record_type = 'revisit'"))


SQL = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
 f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
 select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type, case when page_id is distinct from first then first end as refers_to from p left join f using (payload_digest)"""
