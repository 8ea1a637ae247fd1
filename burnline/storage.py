"""The folder that driver and executors share, and cutting a long plan there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode may it be unset, and is then a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="burnline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Bytes of files that a task reads at most while tables are written here: a task holds what it read to write its shuffle.
READ_BYTES = 32 << 20


@contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """Tasks that read READ_BYTES at most, whatever the size of the input; the session's setting is put back."""
    name = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(name)
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", had.strip().lower()).groups()
    spark.conf.set(name, str(min(READ_BYTES, int(number) << 10 * " kmgtp".index(unit.rstrip("b") or " "))))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once, with its plan cut: what several later steps read isn't planned and computed again by each."""
    shared_folder(df.sparkSession)
    with short_reads(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` computed once as Parquet in the shared folder: like `settle`, where later steps read few of many columns."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    with short_reads(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
