"""Operator 6: WARC archives, one gzip member for each record, and their sequential reader.

The writer gives each task an archive of its own in the shared folder (written
under another name and renamed, so a retried task leaves whole files only). Of
records with equal payloads of at least `least` bytes, the one with the largest
page_id is the response and the others are revisits that name it.

Workers open the shared folder by `open_store`, which knows the names that Hadoop has for file systems; where keys or
end points have to be given, pass an opener of your own.

The reader streams an archive: it inflates a member at a time in small steps,
parses the header, frames the block by its Content-Length, and verifies block
and payload digests. Memory is bounded by one record.

Nulls: a null html is an empty payload; a null url is written as an empty target;
a null page_id never becomes the response of others and is read back as null.
Repeated rows that tie for the largest page_id are all responses. An empty table
gives no archives and no rows. Other columns are ignored."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, salt, shared_path

#: Bytes inflated and read at a time.
STEP = 1 << 16
#: Shares that the copies of a payload are dealt to.
SHARES = 16
RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, position bigint"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(sha1(raw).digest()).decode()


def _identity(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(identity: str) -> int | None:
    number = identity.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_identity(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identity(revisits)}"]
    lines.append(f"Content-Length: {len(block)}")
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(position, contents) of each gzip member, inflated step by step."""
    rest, position, read = b"", 0, 0
    while True:
        if not rest:
            rest = stream.read(STEP)
            read += len(rest)
            if not rest:
                return
        start, inflate, out = read - len(rest), zlib.decompressobj(31), []
        while not inflate.eof:
            out.append(inflate.decompress(inflate.unconsumed_tail or rest, STEP))
            rest = inflate.unused_data
            if not inflate.eof and not inflate.unconsumed_tail:
                rest = stream.read(STEP)
                read += len(rest)
                if not rest:
                    raise ValueError(f"a gzip member at {start} ends early")
        position = start
        yield position, b"".join(out)


def parse(raw: bytes) -> dict:
    """The fields and payload of one record; raises where framing or a digest is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block is not of its Content-Length")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("the payload differs from its length or digest")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None}


def arrow_uri(path: str) -> str:
    """A Hadoop path as the URI by which workers reach it: s3a and s3n are s3, dbfs is mounted on each worker, no scheme is a local path."""
    scheme, colon, rest = path.partition(":/")
    if not colon:
        return f"file://{path}"
    if scheme in ("s3a", "s3n"):
        return f"s3:/{rest}"
    return f"file:///dbfs/{rest.lstrip('/')}" if scheme == "dbfs" else path


def open_store(path: str):
    """(file system, path there) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


def _write(path: str, opener: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = opener(path)
        out, name, n, size = None, f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        held = f"{root}/.{uuid.uuid4().hex}.writing"
        for b in batches:
            for page, url, html, top, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(held, compression=None)
                raw = record(page, url, (html or "").encode(), top, revisit)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            store.move(held, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, path: str, least: int = 0, opener: Callable = open_store) -> DataFrame:
    """Write (page_id, url, html) under `path`: one row (archive, records, bytes) for each archive."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), "url", html.alias("html"), F.octet_length(html).alias("n"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    rows = rows.withColumn("share", salt(SHARES, "page_id", "url"))
    # Copies of a payload are dealt to shares, so that neither one task nor one archive gets them all.
    shares = rows.where(F.col("n") >= least).groupBy("digest", "n", "share").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k"))
    tops = shares.groupBy("digest", "n").agg(F.max("top").alias("top"), F.sum("k").alias("k")).where("k > 1 and top is not null").select("digest", "n", "top")
    told = rows.join(shares.select("digest", "n", "share").join(tops, ["digest", "n"]), ["digest", "n", "share"], "left")
    told = told.select("page_id", "url", "html", "top", (F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("revisit"))
    return told.mapInArrow(_write(path, opener), "archive string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, path: str, archives: list[str] | DataFrame, opener: Callable = open_store) -> DataFrame:
    """Every record of the archives, a task for each archive: see RECORDS."""
    schema = arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opener(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for position, raw in members(stream):
                        held.append(parse(raw) | {"archive": name, "position": position})
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    frame = archives if isinstance(archives, DataFrame) else spark.createDataFrame([(a,) for a in archives], "archive string")
    # A fixed number of tasks: names are so short that adaptive execution would otherwise read all archives in one.
    return frame.select("archive").repartition(max(1, frame.count())).mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder, read them back."""
    from burnline.llm.common import save

    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    written = save(write_archives(pages, path, least), "archives")
    return read_archives(spark, path, written)
