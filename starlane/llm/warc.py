r"""WARC archives: writing pages as records, and a sequential reader.

Each record is a gzip member of its own. A response holds an HTTP header and the payload (the page in UTF-8); of records with
equal payloads the one with the largest page id is the response, and the others are revisits that hold the HTTP header only and
refer to it. The reader takes a file in chunks, inflates one member at a time, frames the block by Content-Length, and compares
block and payload with their digests; damage of any kind raises ValueError.

Archives go to the folder given (by default under the scratch folder that driver and executors share), each under a name of its own
for each attempt of a task; only files of attempts that succeeded are listed in the manifest, and the reader reads that list.

Nulls, ties and the like: a null html is an empty payload; payloads with fewer than `least` bytes are always responses; a null
page_id loses against any other, and if all of a group are null, all are responses; repeated rows with the largest id are
all responses; a null url becomes urn:page:<id>; a page and its record are held whole by the task that writes or reads it; an empty table gives an empty result. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.llm.common import materialize, scratch_path

CHUNK = 1 << 16
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
#: A payload that more than a HOT_PARTS-th of all pages have is found by a broadcast join instead of a shuffle by digest.
HOT_PARTS = 1000
#: The profile of WARC 1.1 revisits: a fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _opened(path: str, mode: str):
    """A binary file; local paths by open(), all others by the file system that their scheme names."""
    if path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), mode)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if "w" in mode else store.open_input_stream(name)


def _folder(path: str) -> None:
    if path.startswith("file:"):
        import os

        os.makedirs(re.sub("^file:/*", "/", path), exist_ok=True)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name)


def record_id(page_id: int | None, payload_digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{payload_digest}").urn


def record(page_id: int | None, url: str | None, payload: bytes, size: int, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}"
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{record_id(page_id, payload_digest)}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{_sha1(block)}"}
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to, payload_digest)}>", "X-Refers-To-Page-Id": str(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class _Record:
    """What has come of one record; keeps no payload unless asked to."""

    def __init__(self, keep: bool):
        self.keep, self.buffer, self.fields, self.http = keep, bytearray(), None, None
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.left = self.payload_bytes = 0
        self.kept = bytearray()

    def feed(self, data: bytes) -> None:
        self.buffer += data
        if self.fields is None:
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                return
            version, self.fields = _fields(bytes(self.buffer[:end]))
            if not version.startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {version[:20]!r}")
            self.left = int(self.fields["content-length"])
            del self.buffer[: end + 4]
        if self.http is None:
            end = self.buffer.find(b"\r\n\r\n", 0, self.left)
            if end < 0:
                return
            self.http = _fields(bytes(self.buffer[:end]))[1]
            self.block.update(self.buffer[: end + 4])
            self.left -= end + 4
            del self.buffer[: end + 4]
        part = bytes(self.buffer[: self.left])
        self.block.update(part)
        self.payload.update(part)
        self.payload_bytes += len(part)
        if self.keep:
            self.kept += part
        self.left -= len(part)
        del self.buffer[: len(part)]

    def close(self) -> dict:
        if self.fields is None or self.http is None or self.left or bytes(self.buffer) != b"\r\n\r\n":
            raise ValueError("the block's length is not Content-Length")
        named = lambda key: self.fields[key].removeprefix("sha1:")
        if base64.b32encode(self.block.digest()).decode() != named("warc-block-digest"):
            raise ValueError("the block does not have its digest")
        kind, whole = self.fields["warc-type"], int(self.http["content-length"])
        if kind == "response" and (self.payload_bytes != whole or base64.b32encode(self.payload.digest()).decode() != named("warc-payload-digest")):
            raise ValueError("the payload does not have its digest or length")
        number = lambda key: int(self.fields[key]) if key in self.fields else None
        out = {"page_id": number("x-page-id"), "url": self.fields["warc-target-uri"], "payload_bytes": whole, "payload_digest": named("warc-payload-digest"), "record_type": kind, "refers_to": number("x-refers-to-page-id")}
        return out | ({"payload": bytes(self.kept)} if self.keep else {})


def read_records(stream: io.BufferedIOBase, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order, chunk by chunk; memory holds a chunk and, if asked for, one payload."""
    inflate = current = None
    while data := stream.read(CHUNK):
        while data:
            if inflate is None:
                inflate, current = zlib.decompressobj(31), _Record(keep_payload)
            try:
                current.feed(inflate.decompress(data, CHUNK))
                while inflate.unconsumed_tail and not inflate.eof:
                    current.feed(inflate.decompress(inflate.unconsumed_tail, CHUNK))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            data = b""
            if inflate.eof:
                data = inflate.unused_data
                yield current.close()
                inflate = None
    if inflate is not None:
        raise ValueError("the archive ends inside a record")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, count, size, path = None, [], 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    _folder(folder)
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _opened(path, "wb")
                data = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["payload_bytes"], row["payload_digest"], row["refers_to"], row["revisit"])
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]})

    return write


def _digested(keep: bool):
    """Adds the payload's length and digest; without keep the rest but page_id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [v.as_buffer() for v in batch.column("html")]
            names = batch.schema.names if keep else ["page_id"]
            columns = [batch.column(n) for n in names]
            sizes, digests = pa.array([len(x) for x in payloads], pa.int64()), pa.array([_sha1(x) for x in payloads], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, sizes, digests], [*names, "payload_bytes", "payload_digest"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes all pages; the manifest (path, records, bytes) of the archives. folder: one that all executors can write to."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = plain.mapInArrow(_digested(True), "page_id long, url string, html string, payload_bytes long, payload_digest string")
    heads = plain.select("page_id", "html").mapInArrow(_digested(False), "page_id long, payload_bytes long, payload_digest string")
    heads = heads.groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    revisit = (F.col("payload_bytes") >= least) & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    heads = materialize(heads, "warc-heads")
    # Fewer than HOT_PARTS payloads can each have so large a part of the pages; their pages stay where they are.
    hot = heads.join(F.broadcast(heads.agg((F.sum("n") / HOT_PARTS).alias("most"))), (F.col("n") > F.col("most")) & (F.col("n") > 1))
    known = known.join(F.broadcast(hot.select("payload_digest", F.col("head").alias("hot_head"), F.lit(True).alias("hot"))), "payload_digest", "left")
    key = F.when(F.col("hot").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    known = known.withColumns({"key": key, "html": F.when(F.col("hot_head").isNull() | F.col("page_id").eqNullSafe(F.col("hot_head")) | (F.col("payload_bytes") < least), F.col("html"))})
    rows = known.join(heads.select(F.col("payload_digest").alias("key"), F.col("head").alias("cold_head")), "key", "left").withColumn("head", F.coalesce("hot_head", "cold_head")).withColumn("revisit", revisit)
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(revisit, F.col("head")).alias("refers_to"), "revisit")
    return materialize(rows.mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if t.endswith("long") else pa.string()) for n, t in zip(names, RECORD.split(", "), strict=True)])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _opened(path, "rb") as stream:
                rows = []
                for row in read_records(stream):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the archives listed."""
    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(_reader, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, least=least))
