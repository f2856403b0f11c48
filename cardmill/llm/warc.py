"""WARC 1.1 archives as a Spark data source, and pages written to them without repeated payloads.

Reading plans whole files, several small ones to a partition. Predicates on
the type and on other headers are pushed into the reader, which parses the
headers of a record first and, where these do not fit, skips its block by length; the
payload of the others is decoded only if payloads are asked for. Payloads are given without the codings of their transfer and content.

Writers put files of their own into the folder and the commit lists those that count
in a manifest, so what lost or repeated tasks leave is not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .tables import stored

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "date string, payload_bytes long, payload binary"
)
# Columns that come straight from a header, on which predicates are pushed down.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "date": "warc-date",
}
MANIFEST = "_manifest-"
FILE_BYTES = 64 << 20  # a writer goes on in a new file beyond
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """The SHA-1 of a payload in base32, as in a header but without its label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def page_record(record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response with the payload as its body, or a revisit with its HTTP head only.

    The head of both says how long the payload is.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Target-URI": uri,
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to:
        return record(fields | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT}, head)
    return record(fields, head + payload)


def _fields(source) -> dict[str, str] | None:
    """The headers of the next record in lower case, or None at the end. A line that starts with a space goes on."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t"):
            fields[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def _column(name: str, fields: dict[str, str]) -> str | None:
    value = fields.get(HEADERS[name])
    if value is None:
        return None
    if name in ("record_id", "refers_to", "target_uri"):
        return value.removeprefix("<").removesuffix(">")
    return value.partition(":")[2] if name == "payload_digest" and ":" in value else value


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, body


def _unchunked(body: bytes) -> bytes:
    """The body without the lengths that a chunked transfer puts between its parts."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].partition(b";")[0] or b"0", 16)
        if not size:
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def _decoded(body: bytes, coding: str) -> bytes:
    """The body without a content coding; as it is if the coding is not known."""
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if coding == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -zlib.MAX_WBITS)
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return body


def _payload(head: dict[str, str], body: bytes, digest: str | None) -> tuple[bytes, bool]:
    """The payload without transfer and content codings, and whether the digest is that of any form of it.

    By the standard a digest covers the body as it was sent; tools also take it without its codings.
    What does not decode is left as it is.
    """
    forms = [body]
    for header, decode in (("transfer-encoding", lambda b, c: _unchunked(b) if c == "chunked" else b), ("content-encoding", _decoded)):
        coding = head.get(header, "").lower()
        if coding and forms[-1]:
            try:
                forms.append(decode(forms[-1], coding))
            except (ValueError, EOFError, OSError, zlib.error, zstandard.ZstdError):
                pass  # such as a coding that was undone when the record was written, its header being kept
    return forms[-1], digest is None or any(payload_digest(form) == digest for form in forms)


def read_records(source, wanted: dict[str, set], payloads: bool) -> Iterator[tuple]:
    """Rows as in ``SCHEMA`` from an open archive, of records whose headers have a value in each set of ``wanted``."""
    seekable = isinstance(source, io.BufferedReader) and source.seekable()  # a compressed one goes on by reading
    while (fields := _fields(source)) is not None:
        length = int(fields.get("content-length", 0))
        own = {name: _column(name, fields) for name in HEADERS}
        if any(own[name] not in values for name, values in wanted.items()):
            if seekable:
                source.seek(length, io.SEEK_CUR)
            else:
                source.read(length)
            continue
        block = source.read(length)
        is_http = fields.get("content-type", "").startswith("application/http")
        head, body = _http(block) if is_http else ({}, block)
        size, payload = head.get("content-length", ""), None
        size = int(size) if size.isdecimal() else None
        if payloads and own["record_type"] != "revisit":
            sha1 = fields.get("warc-payload-digest", "").lower().startswith("sha1:")
            payload, intact = _payload(head, body, own["payload_digest"] if sha1 else None)
            size = len(payload)
            if not intact:
                raise ValueError(f"the payload of {own['record_id']} does not have its digest")
        yield (*own.values(), size, payload)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read_text(files: fs.FileSystem, path: str) -> str:
    with files.open_input_stream(path, compression=None) as stream:
        return stream.read().decode()


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.wanted = path, payloads, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if isinstance(one, (EqualTo, In)) and name in HEADERS:
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                values.discard(None)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(one, IsNotNull) and name in self.wanted):
                yield one

    def partitions(self) -> list[Files]:
        files, root = _folder(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        listed = [f for f in found if f.base_name.startswith(MANIFEST)]
        if listed:
            names = {name for f in listed for name in _read_text(files, f.path).split("\n")}
            found = [f for f in found if f.base_name in names]
        archives = sorted(
            (f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path
        )
        parts, size = [Files([])], 0
        for f in archives:
            if parts[-1].paths and size + f.size > PARTITION_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = _folder(self.path)
        names = [*HEADERS, "payload_bytes", "payload"]
        types = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as raw:
                source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for row in read_records(source, self.wanted, self.payloads):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows ``(record_id, target_uri, date, payload, refers_to)``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in batches:
            columns = [batch.column(name) for name in ("record_id", "target_uri", "date", "payload", "refers_to")]
            for row in zip(*columns):
                if out is None:
                    names.append(f"{uuid.uuid4()}.warc.gz")
                    out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                # Each record is compressed by itself, so that archives can be cut between records.
                data = gzip.compress(page_record(*(cell.as_py() for cell in row)), 1, mtime=0)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4()}") as out:
            out.write("\n".join(name for m in messages if m for name in m.names).encode())


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payloads``: whether payloads are decoded, true by default."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"])


def use_warc(spark: SparkSession) -> None:
    """Makes the format known to a session, with predicates pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


PAGE_ID = "urn:page:"
LEAST_REVISIT_BYTES = 0  # payloads of fewer bytes are not deduplicated
SALTS = 64  # a digest that many pages share is dealt out over so many keys
BROADCAST_REVISITS = 200_000  # about 20 MB
CAPTURED = "2024-01-01T00:00:00Z"


def page_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, first)`` of pages whose payload a page with a smaller id has, or that have no id, from ``(page_id, payload)``.

    Only ids and digests are shuffled. Counting is partial in each map task, and the
    digests that repeat meet their pages under ``SALTS`` keys each.
    """
    marked = pages.filter(F.octet_length("payload") >= LEAST_REVISIT_BYTES).select(
        "page_id", F.sha1("payload").alias("digest")
    )
    firsts = marked.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    repeated = firsts.filter("first < last").select("digest", "first", salts)
    salted = marked.filter("page_id IS NOT NULL").withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    named = salted.join(repeated, ["digest", "salt"]).filter("page_id > first").select("page_id", "digest", "first")
    unnamed = marked.filter("page_id IS NULL").distinct().join(firsts.filter("first IS NOT NULL"), "digest")
    return named.unionByName(unnamed.select("page_id", "digest", "first"))


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Appends a record for each row of ``pages`` to the archives in the folder ``path``.

    The payload is the text in UTF-8, empty for null. Of records with equal payloads
    the one with the smallest id is a response, others are revisits that refer to it.
    Rows that repeat id and payload are as the first of them. Rows without an id come after all ids, and are
    responses if no row with one has their payload; a null URL is empty, extra columns are ignored.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    revisits = stored(page_revisits(rows).distinct(), "revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    marked = rows.withColumn("digest", F.sha1("payload"))
    named = lambda c: F.concat(F.lit(PAGE_ID), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    revisits = revisits.select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "first")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest"))
    records = marked.join(F.broadcast(revisits) if few else revisits, same, "left").select(
        named("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(CAPTURED).alias("date"),
        "payload",
        F.when(F.col("first").isNotNull(), named("first")).alias("refers_to"),
    )
    use_warc(pages.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, payload_bytes, payload_digest, refers_to)`` of all page records in a folder."""
    use_warc(spark)
    records = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE_ID) + 1}) AS BIGINT)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )
