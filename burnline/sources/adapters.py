"""Canonical tables from the driver's `events` and `conversations`.

An account is an event type, its provider the parity of the user. Samples count
tokens in tumbling cycles against a limit of 0.6 times the busiest cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnline.dims import DURATION_US, SERIES
from burnline.functions.times import naive_us
from burnline.operators.lookups import spread, tasks

LIMIT_SHARE = 0.6


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each request."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    tokens = F.floor(F.col("value") * 100).cast("bigint")
    ev = ev.select(
        F.col("event_type").alias("account"),
        F.when(F.col("user_id") % 2 == 0, "claude").otherwise("codex").alias("provider"),
        F.col("user_id").cast("string").alias("request_id"),
        F.col("event_id").cast("string").alias("message_id"),
        naive_us(F.col("ts")).alias("ts_us"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        tokens.alias("t"),
    )
    part = lambda n: F.expr(f"t div {n}")
    return ev.select("account", "provider", "request_id", "message_id", "ts_us", "model", part(2).alias("input_tokens"), part(4).alias("output_tokens"), part(8).alias("cache_creation"), (F.col("t") - part(2) - part(4) - part(8)).alias("cache_read"), F.col("t").alias("total_tokens"))


def kinds(spark: SparkSession) -> DataFrame:
    """The two window kinds and their length."""
    return spark.createDataFrame(list(DURATION_US.items()), "kind string, dur_us bigint")


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    """How many readings there are, by the files' own counts."""
    return len(DURATION_US) * spark.read.parquet(f"{sf_dir}/events.parquet").count()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quota reading for each request and window kind: account, provider, kind, ts_us, used, resets_us, is_estimated."""
    cyc = token_events(spark, sf_dir).select("account", "provider", "message_id", "ts_us", "total_tokens").crossJoin(F.broadcast(kinds(spark)))  # two rows
    cyc = cyc.withColumn("cycle", F.expr("ts_us div dur_us"))
    limits = cyc.groupBy(*SERIES, "cycle").agg(F.sum("total_tokens").alias("s")).groupBy(*SERIES).agg((F.max("s") * LIMIT_SHARE).alias("limit"))
    running = F.sum("total_tokens").over(Window.partitionBy(*SERIES, "cycle").orderBy("ts_us"))
    rows = spread(cyc, tasks(n_samples(spark, sf_dir)), *SERIES, "cycle").withColumn("running", running).join(F.broadcast(limits), SERIES)  # a row a series
    return rows.select(
        *SERIES,
        "ts_us",
        F.least(F.lit(100.0), F.floor(F.col("running") * 100.0 / F.col("limit")).cast("double")).alias("used"),
        F.when(F.col("provider") == "codex", (F.col("cycle") + 1) * F.col("dur_us")).alias("resets_us"),
        ((F.col("provider") == "claude") & (F.col("message_id").cast("bigint") % 3 == 0)).alias("is_estimated"),
    )


def latest_moment(tokens: DataFrame) -> DataFrame:
    """One row, now_us: the time of the last request."""
    return tokens.agg(F.max("ts_us").alias("now_us"))


def live_origins(samples_: DataFrame, now: DataFrame) -> DataFrame:
    """Each series' last reading, judged at `now` (one row)."""
    last = samples_.groupBy(*SERIES).agg(F.max_by(F.struct("ts_us", "used", "resets_us", "is_estimated"), "ts_us").alias("r"))
    return last.crossJoin(F.broadcast(now)).select(*SERIES, "now_us", F.col("r.ts_us").alias("source_us"), F.col("r.used").alias("used"), F.col("r.resets_us").alias("given_us"), F.col("r.is_estimated").alias("is_estimated"))


def replay_origins(samples_: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """Every reading from the second on, judged at its own time; dealt to n_tasks."""
    first = samples_.groupBy(*SERIES).agg(F.min("ts_us").alias("_first"))
    n = F.row_number().over(Window.partitionBy(*SERIES, "ts_us").orderBy("ts_us"))  # of readings at one time
    later = (spread(samples_, n_tasks, *SERIES, "ts_us") if n_tasks else samples_).withColumn("_n", n).join(F.broadcast(first), SERIES).where("ts_us > _first OR _n > 1")  # a row a series
    return later.select(*SERIES, F.col("ts_us").alias("now_us"), F.col("ts_us").alias("source_us"), "used", F.col("resets_us").alias("given_us"), "is_estimated")


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as token events: words of the text are output tokens."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n\\t\\r]+"), lambda w: w != "")).cast("bigint")
    return rows.select(F.lit("claude").alias("provider"), F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("string").alias("message_id"), words.alias("output_tokens"))
