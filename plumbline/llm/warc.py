"""WARC archives: a deduplicating writer and a sequential, verifying reader.

Archives are files of one gzip member per record. The writer makes the row with the least id of equal
payloads a ``response`` and the others ``revisit`` records that refer to it. The reader streams an
archive: it inflates member by member, frames the block by its content length, and verifies the digests
of block and payload. Files go to a folder that all executors share, under names of the task attempt;
the manifest lists those of attempts that succeeded, so a lost executor leaves no half archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import io
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import text as T
from plumbline.llm.graph import checkpointed, salted_join
from plumbline.session import checkpoint_dir

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Compressed bytes at which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>".encode()


def _field(value: str) -> bytes:
    """A header value without line breaks and other controls (percent-encoded)."""
    return "".join(c if ord(c) >= 0x20 and ord(c) != 0x7F else f"%{ord(c):02X}" for c in value).encode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: tuple | None) -> bytes:
    """The bytes of a record; ``refers_to``: None for a response, (page id,) for a revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    lines = [
        VERSION, b"WARC-Type: " + (b"revisit" if refers_to else b"response"), b"WARC-Record-ID: " + record_id(page_id, digest), b"WARC-Date: 1970-01-01T00:00:00Z",
        b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Block-Digest: sha1:" + sha1_base32(block).encode(),
    ]
    if page_id is not None:
        lines.append(b"Page-ID: " + _field(str(page_id)))
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _field(url))
    if refers_to:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(refers_to[0], digest), b"Refers-To-Page-ID: " + _field(str(refers_to[0]))]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time, read in pieces of ``READ_BYTES``."""
    left = b""
    while True:
        inflate, out = zlib.decompressobj(31), io.BytesIO()
        began = False
        while not inflate.eof:
            piece = left or stream.read(READ_BYTES)
            left = b""
            if not piece:
                if began:
                    raise ValueError("a gzip member is cut off")
                return
            began = True
            out.write(inflate.decompress(piece))
        left = inflate.unused_data
        yield out.getvalue()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record; raises if framing or the block digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.partition(b":")
        fields[name.decode().strip().lower()] = value.decode().strip()
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its content length")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("a block digest does not match")
    return fields, block


def http_payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(length of the payload, payload or None for a revisit), with its digest verified."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "revisit":
        return size, None
    if len(payload) != size or fields["warc-payload-digest"] != "sha1:" + sha1_base32(payload):
        raise ValueError("a payload does not match its digest")
    return size, payload


#: Hadoop's names of object stores that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder or file, and its path there."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of the cluster's shared checkpoint folder; one of this machine only where that is unset."""
    base = checkpoint_dir(spark, tempfile.gettempdir() + "/plumbline-checkpoints")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def archive_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages``; returns the manifest (archive, records, bytes).

    Payloads are UTF-8 (null: empty). Of equal payloads of ``min_payload`` bytes or more the least id's
    row is the response (of repeated rows with that id, each); null ids come after all others. Other
    columns are ignored; an empty table writes no archive. The manifest is small: a row per archive.
    """
    spark = pages.sparkSession
    T.prepare(spark)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def measure(batches):
        for batch in batches:
            payloads = T.utf8(batch.column(1))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "digest": pa.array([sha1_base32(p) for p in payloads], pa.string()), "size": pa.array([len(p) for p in payloads], pa.int64())})

    measured = source.select("id", "html").mapInArrow(measure, f"id {kind}, digest string, size long").where(F.col("size") >= min_payload).select("id", "digest")
    first = measured.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeats = salted_join(measured.distinct(), first, "digest", "id").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first")

    def tag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sha1_base32(p) for p in T.utf8(batch.column(2))], pa.string())], names=["id", "url", "html", "digest"])

    tagged = source.mapInArrow(tag, f"id {kind}, url string, html string, digest string").alias("p")
    joined = tagged.join(repeats.alias("r"), F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    rows = joined.select("p.id", "p.url", "p.html", "p.digest", F.col("r.digest").isNotNull().alias("again"), "r.first")

    def write(batches):
        files, where = open_folder(folder)
        files.create_dir(where, recursive=True)
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            html = T.utf8(batch.column(2))
            for page, url, payload, digest, again, least in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = files.open_output_stream(f"{where}/{name}", compression=None), 0, 0
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = press.compress(record(page, url, payload, digest, (least,) if again else None)) + press.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

    return checkpointed(rows.mapInArrow(write, "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record.

    Ids come back as text (null: none). With ``payloads`` also the payload of response records (null for
    revisits). A damaged archive raises; an archive is read by one task, record by record.
    """
    spark = manifest.sparkSession
    T.prepare(spark)
    kinds = [("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), *([("payload", pa.binary())] if payloads else [])]
    schema = pa.schema(kinds)

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = open_folder(uri)
                with files.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        length, payload = http_payload(fields, block)
                        row = (fields.get("page-id"), fields.get("warc-target-uri"), length, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields.get("refers-to-page-id"))
                        rows.append((*row, payload) if payloads else row)
                        size += len(data)
                        if len(rows) >= 1000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    dealt = manifest.select("archive").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    return dealt.mapInArrow(read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)
