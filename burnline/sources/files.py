"""Readers of the raw logs: rollout and transcript lines, desktop snapshots, CLI text and RPC results.

Lines that aren't JSON, lack a field or hold it in another type are dropped, never
fatal. Numbers are read as doubles and then truncated; text is never a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnline.dims import CANDIDATE_FILES
from burnline.functions.times import iso_to_us, reset_phrase_us
from burnline.operators.arbitration import arbitrate

_BLOCK = "struct<used_percent: double, window_minutes: double, resets_at: double, resets_in_seconds: double>"
ROLLOUT = f"timestamp string, payload struct<type: string, info: struct<last_token_usage: struct<input_tokens: double, output_tokens: double>, total_token_usage: struct<total_tokens: double>>, rate_limits: struct<primary: {_BLOCK}, secondary: {_BLOCK}>>"
TRANSCRIPT = "timestamp string, requestId string, message struct<id: string, role: string, model: string, usage: struct<input_tokens: double, output_tokens: double, cache_creation_input_tokens: double, cache_read_input_tokens: double>>"
DESKTOP = "samples array<struct<t: double, org: string, u: struct<fh: double, sd: double>>>"
_RPC = "struct<usedPercent: double, windowDurationMins: double, resetsAt: double>"
RPC = f"rateLimits struct<primary: {_RPC}, secondary: {_RPC}>"


def lines(spark: SparkSession, paths: list[str], name: str, modified_after: str | None = None) -> DataFrame:
    """(file, mtime, pos, line) of every line of the files below `paths` whose name matches; only those modified after a time in UTC if asked."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if modified_after:
        read = read.option("modifiedAfter", modified_after).option("timeZone", "UTC")
    whole = read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), "value")
    return whole.select("file", "mtime", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def classify(minutes: Column) -> Column:
    """A window's kind by its length alone: about five hours, or from 150 hours on."""
    m = minutes.cast("bigint")
    return F.when(m.between(250, 350), "w5h").when(m >= 9000, "weekly")


def rollout_events(lines_: DataFrame) -> DataFrame:
    """Token-count lines: file, mtime, pos, stamp and payload."""
    parsed = lines_.withColumn("j", F.from_json("line", ROLLOUT))
    return parsed.where("j.payload.type = 'token_count'").select("file", "mtime", "pos", F.col("j.timestamp").alias("stamp"), F.col("j.payload").alias("payload"))


def _reading(block: Column, ts_us: Column) -> Column:
    """A block as (kind, used, resets_us); the kind is null where it can't be used."""
    kind = F.when(block["used_percent"].isNotNull(), classify(block["window_minutes"]))
    resets = F.coalesce(F.round(block["resets_at"] * 1e6).cast("bigint"), ts_us + F.round(block["resets_in_seconds"] * 1e6).cast("bigint"))
    return F.struct(kind.alias("kind"), block["used_percent"].alias("used"), block["window_minutes"].cast("int").alias("window_minutes"), resets.alias("resets_us"))


def newest_files(spark: SparkSession, paths: list[str], name: str, newest: int = CANDIDATE_FILES) -> list[str]:
    """The few files below `paths` that were modified last; none is opened."""
    if not paths:
        return []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(paths)
    return [r.path for r in found.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(newest).collect()]


def rollout_candidates(events: DataFrame, newest: int = CANDIDATE_FILES) -> DataFrame:
    """The last snapshots of the newest files as candidates of each kind, the newest file first."""
    last = events.where("payload.rate_limits IS NOT NULL").groupBy("file").agg(F.max("mtime").alias("mtime"), F.max_by(F.struct("stamp", "payload"), "pos").alias("s"))
    top = last.orderBy(F.desc("mtime"), F.desc("file")).limit(newest).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mtime"), F.desc("file"))))  # a few files
    rows = top.withColumn("ts_us", iso_to_us(F.col("s.stamp"))).where("ts_us IS NOT NULL")
    limits = F.col("s.payload.rate_limits")
    each = F.explode(F.array(_reading(limits["primary"], F.col("ts_us")), _reading(limits["secondary"], F.col("ts_us")))).alias("r")
    return rows.select("rank", "ts_us", each).where("r.kind IS NOT NULL").select("rank", "ts_us", "r.kind", "r.used", "r.resets_us")


def rollout_readings(events: DataFrame, newest: int = CANDIDATE_FILES) -> DataFrame:
    """Each kind's winning reading among the last snapshots of the newest files."""
    return arbitrate(rollout_candidates(events, newest), ["kind"])


def suppress_repeats(events: DataFrame, file: str = "file", order: str = "pos", total: str = "total") -> DataFrame:
    """Rows whose cumulative total equals the last known one before them in their file are repeats and go."""
    before = F.last(total, ignorenulls=True).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).where(~F.coalesce(F.col(total) == F.col("_before"), F.lit(False))).drop("_before")


def rollout_changes(events: DataFrame) -> DataFrame:
    """Token events by step, and repeats of a cumulative total as `gone`: their identity is taken back, should it be stored.

    The file's stem and the time's text identify an event; what the last line of an identity says counts, and of equal stems
    the file modified first is heard last. Caches count as none."""
    total = F.col("payload.info.total_token_usage.total_tokens").cast("bigint")
    rows = events.withColumn("total", total).withColumn("before", F.last("total", ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    use, stem = F.col("payload.info.last_token_usage"), F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = rows.withColumn("gone", F.coalesce(F.col("total") == F.col("before"), F.lit(False))).withColumn("ts_us", iso_to_us(F.col("stamp")))
    rows = rows.where(F.col("ts_us").isNotNull() & (F.col("gone") | (use["input_tokens"].isNotNull() & use["output_tokens"].isNotNull())))
    counts = [use["input_tokens"].cast("bigint").alias("input_tokens"), use["output_tokens"].cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("cache_creation"), F.lit(0).cast("bigint").alias("cache_read")]
    rows = rows.select(F.lit("codex").alias("provider"), stem.alias("request_id"), F.col("stamp").alias("message_id"), "ts_us", *counts, "gone", F.struct((-F.col("mtime")).alias("m"), "file", "pos").alias("at"))
    return rows.groupBy("provider", "request_id", "message_id").agg(F.max_by(F.struct("*"), "at").alias("r")).select("r.*").drop("at")


def rollout_token_events(events: DataFrame) -> DataFrame:
    """Per-step token events without repeats."""
    return rollout_changes(events).where(~F.col("gone")).drop("gone")


def transcript_token_events(lines_: DataFrame) -> DataFrame:
    """Assistant lines with usage, the last line of an id winning, over all files."""
    j = lines_.withColumn("j", F.from_json("line", TRANSCRIPT)).where("j.message.role = 'assistant' AND j.message.usage IS NOT NULL AND j.requestId IS NOT NULL AND j.message.id IS NOT NULL AND j.message.model IS NOT NULL")
    count = lambda c: F.coalesce(F.col(f"j.message.usage.{c}"), F.lit(0.0)).cast("bigint")
    rows = j.select(
        F.lit("claude").alias("provider"),
        F.col("j.requestId").alias("request_id"),
        F.col("j.message.id").alias("message_id"),
        iso_to_us(F.col("j.timestamp")).alias("ts_us"),
        F.col("j.message.model").alias("model"),
        count("input_tokens").alias("input_tokens"),
        count("output_tokens").alias("output_tokens"),
        count("cache_creation_input_tokens").alias("cache_creation"),
        count("cache_read_input_tokens").alias("cache_read"),
        "file",
        "pos",
    ).where("ts_us IS NOT NULL")
    key = ["provider", "request_id", "message_id"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct("file", "pos")).alias("r")).select("r.*").drop("file", "pos")


def desktop_readings(spark: SparkSession, path: str) -> DataFrame:
    """Every retained sample of the last sample's organisation, a row for each kind; no resets."""
    rows = spark.read.schema(DESKTOP).option("multiLine", True).json(path).select(F.posexplode("samples").alias("pos", "s")).where("s.t IS NOT NULL")
    org = rows.agg(F.max_by("s.org", F.struct("s.t", "pos")).alias("org"))
    own = rows.join(F.broadcast(org), F.col("s.org").eqNullSafe(F.col("org")))  # one row
    kinds = F.explode(F.array(F.struct(F.lit("w5h").alias("kind"), F.col("s.u.fh").alias("used")), F.struct(F.lit("weekly").alias("kind"), F.col("s.u.sd").alias("used")))).alias("k")
    return own.select((F.col("s.t") * 1000).cast("bigint").alias("ts_us"), kinds).select("ts_us", "k.*").where("used IS NOT NULL").withColumn("resets_us", F.lit(None).cast("bigint"))


def cli_readings(texts: DataFrame) -> DataFrame:
    """(now_us, line) of usage text to (kind, used, resets_us); lines for single models are passed over."""
    pattern = r"(?i)^\s*current\s+(session|week \(all models\))\s*:\s*(\d+(?:\.\d+)?)%\s*used(?:\s*\S+\s*resets\s+(.+?)\s*\(([^)]+)\))?\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = texts.where(F.col("line").rlike(pattern))
    return rows.select("now_us", F.when(F.lower(part(1)) == "session", "w5h").otherwise("weekly").alias("kind"), part(2).cast("double").alias("used"), F.when(part(3) != "", reset_phrase_us(part(3), part(4), F.col("now_us"))).alias("resets_us"))


def rpc_readings(results: DataFrame) -> DataFrame:
    """(now_us, body) of RPC results to (kind, used, resets_us)."""
    j = results.select("now_us", F.from_json("body", RPC).alias("j"))
    rows = j.select("now_us", F.explode(F.array("j.rateLimits.primary", "j.rateLimits.secondary")).alias("b"))
    return rows.select("now_us", classify(F.col("b.windowDurationMins")).alias("kind"), F.col("b.usedPercent").alias("used"), F.round(F.col("b.resetsAt") * 1e6).cast("bigint").alias("resets_us")).where("kind IS NOT NULL AND used IS NOT NULL")
