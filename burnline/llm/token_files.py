"""Operator 1: token ids in ORC files.

Documents are dealt by ranges of doc_id, encoded, and written sorted, so file
order is doc_id order. Each ORC file holds integer run-length encoded id lists,
a row index every few thousand rows and a Bloom filter on doc_id; readers take
stripes in parallel and skip those that a doc_id predicate rules out.

Nulls: a null text is empty (its ids are the end id alone); a null doc_id sorts
first. Repeated rows are all kept, next to each other. An empty table gives an
empty folder that reads back as no rows. Other columns are ignored. A very long
text is encoded whole by one task and makes one long row of its stripe."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnline.llm.common import arrow_schema, shared_path
from burnline.llm.wordbpe import runs

#: Fixed by the file format: part is the file's place in doc_id order, part_start the ids of the part before the document.
SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"
#: Writer settings of the files.
ORC = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


def _encoded(tokenizer: str, end_id: int):
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = runs(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = [encode(t.as_py() or "") + end for t in batch.column(1)]
            sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(raw), part), pa.int32()), pa.array(at + total[:-1]), pa.array(sizes), ids], schema=schema)
            at += int(total[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode `text`, append `end_id`, and write ORC files under `path` in ascending doc_id order."""
    dealt = docs.select(F.col("doc_id").cast("bigint"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encoded(tokenizer, end_id), SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of `write_tokens` with `start`: the ids of all documents before each."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # One row for each file: the window below sees as many rows as there are files.
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(sizes.select("part", F.coalesce(before, F.lit(0)).alias("_before")), "part").select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids", "part")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: files, stripes and row groups are passed over by their ranges and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def crc_of_ids(rows: DataFrame) -> DataFrame:
    """Replace `ids` by ids_crc32, the unsigned crc32 of the ids as little-endian 32-bit integers."""
    keep = [c for c in rows.columns if c != "ids"]
    out = rows.select(*keep, "ids")
    schema = out.drop("ids").withColumn("ids_crc32", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(keep))
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    return out.mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return crc_of_ids(read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids"))
