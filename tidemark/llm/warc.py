"""WARC archives of pages: written as one gzip stream per file, normalised to one gzip member per record, read by index.

`write` makes archives as many crawlers leave them: each file a single gzip stream, which can only be read from its start.
`normalise` inflates such a stream once, in pieces, rewrites every record as a gzip member of its own, and writes a sidecar
index beside the archive (one line of JSON for each record: offset, length, id, type). `read` takes the index and opens
records at their offsets.

Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a response and the
others revisit it; a revisit holds no payload, but its digest and length. Files go to the folder all executors share; a
task's files have names of their own, and only those of tasks that ended well are in the list the next step reads.

Defined cases: a NULL payload is empty; a NULL page_id is kept as such and revisits if its payload has a smaller id; rows of one
page_id and payload are all responses if that id is the smallest; a URL is escaped, NULL becomes about:blank; an empty table
gives no file and an empty result. A payload that does not have its digest when it is read back is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folder, staged

#: Bytes of records after which the next archive begins.
ARCHIVE = 64 << 20
READ = 1 << 20
#: Bytes inflated at once.
INFLATED = 4 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LEVEL = 5


def opened(uri: str):
    """(file system, path) of a path or URI that all executors reach."""
    from pyarrow import fs

    if re.match(r"file:/|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record; `refers_to` is the page a revisit refers to, or None for a response."""
    block = HTTP + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}",
        f"Content-Type: application/http; msgtype=response; kind={kind}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(map(chr, range(33, 127)))


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:] if line)}


def page_of(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1]
    return int(name) if name else None


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to of every page."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = (
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
        .select(F.col("payload_digest").alias("shared"), "first")
    )
    # small payloads have no partner: their own digests, spread by page, find none
    key = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(
        F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("key", key).join(firsts, F.col("key") == F.col("shared"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write(rows: DataFrame, to: str) -> DataFrame:
    """Write the rows of `with_revisits` to archives under `to`, each a single gzip stream; one row (archive, records) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(to)
        system.create_dir(root, recursive=True)
        out = name = None
        size = records = 0

        def close():
            out.write(stream.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["archive", "records"])

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                page_id, url, payload, digest, n, refers = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"{root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out, stream, size, records = system.open_output_stream(name, compression=None), zlib.compressobj(1, wbits=31), 0, 0
                made = record(page_id, url, payload, digest, n, refers)
                out.write(stream.compress(made))
                size, records = size + len(made), records + 1
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "archive string, records bigint")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of at most `INFLATED` bytes, however well they were packed."""
    inflate = zlib.decompressobj(wbits=31)
    while raw := source.read(READ):
        while raw:
            yield inflate.decompress(raw, INFLATED)
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)
    while piece := inflate.decompress(b"", INFLATED):  # what the last bytes still held back
        yield piece


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) in turn; holds one record and one piece at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            found = fields(bytes(held[:end]))
            whole = end + 4 + int(found["content-length"]) + 4
            if len(held) < whole:
                break
            yield found, bytes(held[:whole])
            del held[:whole]
    if held:
        raise ValueError("the stream ends inside a record")


def normalise(archives: DataFrame, to: str) -> DataFrame:
    """Rewrite each archive with a gzip member for every record; one row (archive, index, records) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield one(path)

    def one(path: str) -> pa.RecordBatch:
        system, root = opened(to)
        system.create_dir(root, recursive=True)
        name = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        offset = count = 0
        with (system.open_input_stream(path, compression=None) as source,
              system.open_output_stream(f"{name}.warc.gz", compression=None) as out,
              system.open_output_stream(f"{name}.idx", compression=None) as index):
            for found, whole in records_of(inflated(source)):
                stream = zlib.compressobj(_LEVEL, wbits=31)
                member = stream.compress(whole) + stream.flush()
                out.write(member)
                line = {"offset": offset, "length": len(member), "id": found["warc-record-id"], "type": found["warc-type"]}
                index.write(json.dumps(line).encode() + b"\n")
                offset, count = offset + len(member), count + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([count], pa.int64())],
            names=["archive", "index", "records"])

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, "archive string, index string, records bigint")


def read(archives: DataFrame, to: str, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each opened at its offset: page_id, url, payload (NULL for revisits and if not
    wanted), payload_bytes, payload_digest, record_type, refers_to. Payloads are checked against their digests."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(to)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(index, compression=None) as lines:
                    places = [json.loads(line) for line in lines.read().splitlines()]
                with system.open_input_file(path) as archive:
                    rows, size = [], 0
                    for place in places:
                        archive.seek(place["offset"])
                        rows.append(row(zlib.decompress(archive.read(place["length"]), wbits=31)))
                        size += rows[-1][3]
                        if size > READ or len(rows) >= 1000:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    def row(whole: bytes) -> tuple:
        end = whole.index(b"\r\n\r\n")
        found = fields(whole[:end])
        block = whole[end + 4 : end + 4 + int(found["content-length"])]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest, kind = found["warc-payload-digest"].removeprefix("sha256:"), found["warc-type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{found['warc-record-id']}: the payload does not have its digest")
        return (page_of(found["warc-record-id"]), found["warc-target-uri"], payload if payloads and kind == "response" else None,
                len(payload) if kind == "response" else int(found["payload-length"]), digest, kind,
                page_of(found["warc-refers-to"]) if kind == "revisit" else None)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return archives.select("archive", "index").repartition(max(1, archives.count())).mapInArrow(run, schema)


def archived(pages: DataFrame, least_bytes: int = 100) -> tuple[DataFrame, str]:
    """Write, normalise: (archives with their indexes, folder)."""
    spark = pages.sparkSession
    raw, to = folder(spark, "warc-stream"), folder(spark, "warc")
    streams = staged(write(with_revisits(pages, least_bytes), raw))
    return staged(normalise(streams, to)), to


SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to FROM f"""
