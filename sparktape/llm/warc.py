"""WARC archives with a dictionary: a writer and a reader for pages.

Of pages with equal payloads of at least ``REVISIT_BYTES``, the one with the smallest id is archived as a response, the
others as revisits that hold no payload, only its HTTP head. A Zstandard dictionary is built once from a bounded sample of
records as they are archived; every file starts with it in a skippable frame, and each record is a frame of its own, so any
record can be read alone. Without enough records to train on, their own bytes are the dictionary.

Equal payloads are found on SHA-256 digests; only digests that repeat are joined back, a join that Spark may split where
one digest holds many pages. Every task writes files of its own under fresh names in the shared folder and hands in their
names once they are closed; what a lost task leaves behind is never read. Files are read as streams, a record at a time, and
every payload is checked against its digest.

Null payloads are empty. Null urls are archived as ``about:blank``, null ids as ``null``. Rows that repeat the smallest id
of their group are all responses; a group without ids has no smallest one, so all its rows are. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.lineage import fresh_path, saved
from sparktape.llm.words import sampled

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
#: Records that the dictionary is built from, the bytes of each, and the dictionary's own size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 14, 112_640
LEVEL = 3

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:sparktape:page:"


def files(uri: str) -> tuple[FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


def record(key, url: str | None, payload: bytes, digest: str, size: int, first, date: str) -> bytes:
    """A response, or a revisit of ``first`` if that is another page, as the bytes of a WARC record."""
    revisit = first is not None and first != key
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'null' if key is None else key}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <{ID}{first}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:  # too few to train on
        return b"".join(records)[:DICTIONARY_BYTES]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def marked(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, payload, digest, size, first): ``first`` is the smallest key of those that share a payload, else null."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    return rows.join(saved(shared.where("n > 1").drop("n")), "digest", "left")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive all pages below ``folder``; a saved table (path, records, bytes) of the files, empty ones left out."""
    spark = pages.sparkSession
    ids = sampled(pages.select(F.col(key).alias("key")).where(F.col(key).isNotNull()).distinct(), "key", SAMPLE)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.substring(F.col(html).cast("binary"), 1, SAMPLE_BYTES).alias("html"))
    head = rows.join(F.broadcast(ids), "key", "left_semi").dropDuplicates(["key"]).orderBy("key")
    samples = []
    for row in head.collect():
        part = bytes(row[2] or b"")
        samples.append(record(row[0], row[1], part, hashlib.sha256(part).hexdigest(), len(part), None, date))
    sent = spark.sparkContext.broadcast(dictionary(samples))
    rows = marked(pages, key, url, html)
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{{}}>\r\nWARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

    def archive(batches):
        raw = sent.value
        store, base = files(folder)
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(raw), write_content_size=True) if raw else zstandard.ZstdCompressor(level=LEVEL)
        out, name, made, filled, written = None, "", [], 0, 0
        for batch in batches:
            for key, url, payload, digest, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw + packer.compress(info.format(uuid.uuid4()).encode()))
                    filled = written = 0
                whole = record(key, url, payload, digest, size, first, date)
                out.write(packer.compress(whole))
                filled, written = filled + len(whole), written + 1
                if filled >= FILE_BYTES:
                    out.close()
                    made.append((name, written, filled))
                    out = None
        if out is not None:
            out.close()
            made.append((name, written, filled))
        yield pa.RecordBatch.from_pylist(
            [{"path": f"{folder}/{n}", "records": w, "bytes": b} for n, w, b in made],
            pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    rows = rows.select("key", "url", "payload", "digest", "size", "first")
    return saved(rows.mapInArrow(archive, "path string, records long, bytes long"))


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of the records of one file, its dictionary taken from the leading frame."""
    store, name = files(path)
    with store.open_input_stream(name, compression=None) as source:
        mark, size = struct.unpack("<II", source.read(8))
        if mark != SKIPPABLE:
            raise ValueError(f"{path} does not start with a dictionary")
        raw = source.read(size)
        unpacker = zstandard.ZstdDecompressor(dict_data=_loaded(raw)) if raw else zstandard.ZstdDecompressor()
        stream = io.BufferedReader(unpacker.stream_reader(source, read_across_frames=True, closefd=False), 1 << 16)
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at its place")
            head = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                field, _, value = line.decode().partition(": ")
                head[field] = value
            block = stream.read(int(head["Content-Length"]))
            stream.read(4)
            yield head, block


def _key(value: str | None) -> str | None:
    own = value[1 + len(ID) : -1] if value else None
    return None if own == "null" else own


def read(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """(key, payload, payload_bytes, payload_digest, record_type, refers_to, url) of all records in the files of a manifest."""
    number = max(1, manifest.count())

    def rows(batches):
        schema = pa.schema([("key", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, held = [], 0
                for head, block in records(path):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: a payload does not have its digest")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    own = payload if kind == "response" else None
                    found.append((_key(head["WARC-Record-ID"]), own, size, digest, kind, _key(head.get("WARC-Refers-To")), head["WARC-Target-URI"]))
                    held += len(block)
                    if held > 8 << 20 or len(found) >= 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)
                        found, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)

    names = manifest.select("path").repartition(number, "path")
    out = names.mapInArrow(rows, "key string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumns({"key": F.col("key").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def op4(spark, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back."""
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read(manifest).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as payload from pages
), digests as (
  select page_id, octet_length(encode(payload)) as payload_bytes, sha256(payload) as payload_digest from payloads
), shared as (
  select payload_digest, min(page_id) as first from digests where payload_bytes >= 100 group by 1 having count(*) > 1
), marked as (
  select digests.*, case when first <> page_id then first end as refers_to from digests left join shared using (payload_digest)
)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from marked
"""
