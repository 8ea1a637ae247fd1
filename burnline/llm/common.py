"""Helpers shared by the corpus operators: shared storage, Arrow batches, ranks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An Arrow batch handed to a Python worker holds at most this many bytes.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="burnline-")
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths made inside `scratch`, innermost last.
_scratch: list[list[str]] = []


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path of its own below the shared folder; inside `scratch` it goes with it, or (keep) with the one around it, if any."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what operators write to the shared folder inside: for results that have been written elsewhere by the end."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, str(2**31 - 1))) > 4 * BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception as e:  # a Spark without that setting, or a value with a unit
        if "CANNOT_MODIFY" not in str(e) and not isinstance(e, ValueError):
            raise


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table by its path; the session's Arrow batches are bounded on the way."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the bytes of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows that hold at most `limit` bytes together; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of simple types; works in Python workers."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(","))])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salt(n: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def dense_rank_in(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each key, without gathering a key in one task.

    Rows are dealt by (key, hash of the order columns); numbers within such a
    share get the sizes of the shares before it added. Equal order columns are
    numbered arbitrarily."""
    n = partitions(df.sparkSession)
    df = df.withColumn("_share", salt(n, *order))
    by = [*keys, "_share"]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return local.join(sizes, by).withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_before", "_share")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (src, dst): the smallest id that links reach.

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots and contracts the links to links between roots;
    rounds are logarithmic in practice. Only grouped minima and equi joins are
    used, so a hub's links are pre-aggregated and its join can be split.
    Tables of each round go to the shared folder."""
    edges = save(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = save(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to")).select("id", F.least("id", "to").alias("to")), "up")
        while True:
            onward = up.select(F.col("id").alias("to"), F.col("to").alias("next")).where("to <> next")
            moved = save(up.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "up")
            up = moved.select("id", "to")
            if moved.where("moved").isEmpty():
                break
        if label is None:
            label = up.select("id", F.col("to").alias("component"))
        else:
            label = save(label.join(up.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "label")
        a, b = up.select(F.col("id").alias("src"), F.col("to").alias("_a")), up.select(F.col("id").alias("dst"), F.col("to").alias("_b"))
        edges = edges.join(a, "src").join(b, "dst").where("_a <> _b").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct()
        edges = save(edges, "links")
    return label if label is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
