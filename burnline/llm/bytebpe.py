"""Operator 8: byte-level BPE encoding and decoding with overlapping chunks.

A text above LONG characters is cut into chunks that overlap. Each chunk is
pre-tokenised by itself, wherever it starts; as the pattern never looks back,
two chunks that share one boundary in their overlap share all later ones. The
first shared boundary that follows a non-space (where what comes next cannot
change the pre-token before) is where the pieces are stitched. Pieces are then
encoded in parallel and their ids concatenated. If an overlap holds no such
boundary, the text is encoded as one piece. Decoding concatenates raw bytes.

Nulls: a null text is empty and has no ids. Repeated rows are encoded each. An
empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.llm.common import save

#: Characters of a text above which it is cut; of a chunk; and of the overlap of two chunks.
LONG, CHUNK, OVERLAP = 1 << 16, 1 << 15, 512
#: Chunks or pieces that a task hands on at a time.
SENT = 64


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, low: int, high: int) -> list[int]:
    """Ends of pre-tokens in [low, high) of a chunk that follow a non-space character."""
    return [e for m in _pattern(pattern).finditer(text) if low <= (e := m.end()) < high and not text[e - 1].isspace()]


def _chunk_ends(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, k, at, last, chunk) to the boundaries in the chunk's overlaps, counted from the text's start."""
        for b in batches:
            head, tail = [], []
            for at, last, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                head.append([at + e for e in boundaries(text[: 2 * OVERLAP], pattern, 0, OVERLAP)] if at else [])
                tail.append([] if last else [at + e for e in boundaries(text, pattern, CHUNK, CHUNK + OVERLAP)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(head, kind), pa.array(tail, kind)], names=["row", "k", "head", "tail"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to overlapping chunks (row, k, at, last, chunk), a few at a time."""
    names = ["row", "k", "at", "last", "chunk"]
    for b in batches:
        for row, text in zip(b.column(0), b.column(1), strict=True):
            t = text.as_py()
            for first in range(0, len(t), CHUNK * SENT):
                at = list(range(first, min(first + CHUNK * SENT, len(t)), CHUNK))
                cols = [pa.array([row.as_py()] * len(at), pa.int64()), pa.array([a // CHUNK for a in at], pa.int64()), pa.array(at, pa.int64()), pa.array([a + CHUNK >= len(t) for a in at]), pa.array([t[a : a + CHUNK + 2 * OVERLAP] for a in at], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text, cuts) to the pieces between cuts (row, doc_id, k, text), a few at a time."""
    names = ["row", "doc_id", "k", "text"]
    for b in batches:
        for row, doc, text, cuts in zip(*b.columns, strict=True):
            t, ends = text.as_py(), [0, *cuts.as_py()]
            for first in range(0, len(ends), SENT):
                ks = range(first, min(first + SENT, len(ends)))
                cols = [pa.array([row.as_py()] * len(ks), pa.int64()), pa.array([doc.as_py()] * len(ks), pa.int64()), pa.array(ks, pa.int64()), pa.array([t[ends[k] : ends[k + 1] if k + 1 < len(ends) else len(t)] for k in ks], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)


def _encode(ranks_path: str, pattern: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column, text, to ids as little-endian 32-bit bytes; `keep` columns before it pass."""
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = [np.array(enc.encode_ordinary(t.as_py() or ""), "<u4").tobytes() for t in b.column(keep)]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(ids, pa.binary())], names=[*b.schema.names[:keep], "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, long: int = LONG) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    short = rows.where(n <= long).mapInArrow(_encode(ranks_path, pattern, 1), "doc_id bigint, ids binary")
    longs = save(rows.where(n > long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    if longs.isEmpty():
        return short
    # Python slices a text by position, where a string function would walk to each place from the start.
    cut = longs.select("row", "text").mapInArrow(_cut, "row bigint, k bigint, at bigint, last boolean, chunk string")
    ends = cut.repartition("row", "k").mapInArrow(_chunk_ends(pattern), "row bigint, k bigint, head array<bigint>, tail array<bigint>")
    # A text has one small entry for each chunk here.
    chunks = ends.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("c"))
    cuts = chunks.select("row", F.expr("transform(sequence(1, greatest(size(c) - 1, 1)), i -> array_min(array_intersect(get(c, i - 1).tail, get(c, i).head)))").alias("cuts"), F.size("c").alias("k"))
    cuts = cuts.withColumn("cuts", F.expr("CASE WHEN k = 1 OR exists(cuts, x -> x IS NULL) THEN array_except(cuts, cuts) ELSE cuts END"))
    piece = longs.select("row", "doc_id", "text").join(cuts.select("row", "cuts"), "row").select("row", "doc_id", "text", "cuts")
    piece = piece.mapInArrow(_stitched, "row bigint, doc_id bigint, k bigint, text string")
    done = piece.repartition("row", "k").mapInArrow(_encode(ranks_path, pattern, 3), "row bigint, doc_id bigint, k bigint, ids binary")
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    joined = whole.select("doc_id", F.unhex(F.concat_ws("", F.transform("p", lambda p: F.hex(p["ids"])))).alias("ids"))
    return short.unionByName(joined)


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`rows` with a column `decoded`: the raw bytes of the ids in its last column, `ids`."""
    keep = len(rows.columns)
    schema = rows.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(np.frombuffer(i or b"", "<u4").tolist()) for i in b.column(keep - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to n_tokens, the digest of the decimal ids joined by commas, and that of the decoded bytes.

    Decodes in the same pass, so a task has one Python worker for it, not three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        enc, digits = encoding(ranks_path, pattern), [str(i) for i in range(1 << 16)]
        for b in batches:
            n, text, raw = [], [], []
            for i in b.column(1):
                ids = np.frombuffer(i.as_buffer() or b"", "<u4")
                flat = ids.tolist()
                words = map(digits.__getitem__, flat) if not flat or ids.max() < len(digits) else map(str, flat)
                n.append(len(flat))
                text.append(sha256(",".join(words).encode()).hexdigest())
                raw.append(sha256(enc.decode_bytes(flat)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(encode(docs, ranks_path, pattern), ranks_path, pattern)
