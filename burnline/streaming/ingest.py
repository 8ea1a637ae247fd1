"""Incremental ingest of log files: a file stream whose checkpoint is the cursor.

For files that come whole: a file stream doesn't look at a file again once it has seen it. Logs that
grow go through `sources.increments`. An id may come again, so the sink writes keep-last by key. New
lines of a finished batch are visible only once the batch is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.operators.store import EVENT_KEY, above_floor
from burnline.sources.files import transcript_token_events


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of new files below `path`, as a stream."""
    read = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("wholetext", True)
    whole = read.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), "value")
    return whole.select("file", "mtime", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def ingest_transcripts(spark: SparkSession, path: str, table: str, checkpoint: str, floor_us: int = 0):
    """Run to the end of what is there: events above the floor are appended to `table` batch by batch.

    Readers of the table take the last row of a key by batch (`current_events`)."""

    def write(batch: DataFrame, number: int) -> None:
        events = above_floor(transcript_token_events(batch), floor_us)
        events.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(table)

    return transcript_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_events(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.parquet(table)
    return rows.groupBy(*EVENT_KEY).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*").drop("batch")
