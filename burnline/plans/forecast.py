"""From samples, token events and origins to facts and forecasts, many series and moments at once.

An origin is a series and a moment (now_us) at which it is judged from what was
known by then: a live tick has one for each series, a replay has many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.config import Predictor
from burnline.dims import SERIES
from burnline.operators import burn, cycles, projection
from burnline.operators.lookups import as_of, tasks
from burnline.storage import written

KEYS = [*SERIES, "now_us"]


def facts(samples: DataFrame, tokens: DataFrame, origins: DataFrame, settings: Predictor = Predictor(), near: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """One row for each origin: its reading, block, boundary, token sums, reset (given or derived) and live rate.

    What a series has come to by each reading is computed once; an origin looks it up as of its moment and as of
    retention before it. Only the readings of the short lookback slide past it for the slope; `near` are those of
    `samples` that any origin's lookback holds, where the caller knows; `rows` is how many `samples` there are,
    and no fewer than origins, if the caller knows it. Work follows readings, tokens and origins, not their product,
    and so does the number of tasks, so that none needs more memory for more of them."""
    n = tasks(samples.count() if rows is None else rows)
    out, blocks = _situations(samples, tokens, origins, settings, n)
    return burn.live_rate(out, samples if near is None else near, SERIES, settings.lookback_us(), blocks, n)


def situations(samples: DataFrame, tokens: DataFrame, origins: DataFrame, settings: Predictor = Predictor(), rows: int | None = None) -> DataFrame:
    """`facts` without the live rate, for which no slope needs to be fitted."""
    return _situations(samples, tokens, origins, settings, tasks(samples.count() if rows is None else rows))[0]


def _situations(samples: DataFrame, tokens: DataFrame, origins: DataFrame, settings: Predictor, n: int | None) -> tuple[DataFrame, DataFrame]:
    kept = settings.retention_us()
    state = written(cycles.running_state(samples, SERIES, n).select(*SERIES, *cycles.STATE))
    origins = written(origins.dropna(subset=KEYS))
    found = as_of(origins, state, SERIES, "now_us", cycles.STATE[1:], "cur", n=n)
    first, last = state.agg(F.min("ts_us")).first()[0], origins.agg(F.max("now_us")).first()[0]
    if first is not None and last is not None and last - kept >= first:
        found = written(found).withColumn("_limit", F.col("now_us") - kept)  # a lookup reads them twice
        found = as_of(found, state, SERIES, "_limit", cycles.OLD_STATE, "old", n=n).drop("_limit")
    else:  # all readings are within retention
        found = found.withColumn("old", F.lit(None).cast(state.select(F.struct("ts_us", *cycles.OLD_STATE)).schema[0].dataType))
    blocks = written(cycles.block_facts(found, kept))
    out = burn.token_facts(blocks, tokens, KEYS, settings.lookback_us(), n)
    derived = cycles.derived_reset(F.col("anchor_us"), F.col("token_after_us"), F.col("n_tokens").isNotNull())
    return out.withColumn("resets_us", F.coalesce(F.col("given_us").cast("double"), derived)), blocks


def linear(samples: DataFrame, tokens: DataFrame, origins: DataFrame, tz: str = "UTC") -> DataFrame:
    return projection.linear(facts(samples, tokens, origins), tz)


def stored(linear_: DataFrame, simulated: DataFrame) -> DataFrame:
    """Both models' forecasts as stored rows: (series, model, made_us, used, status, burn, eta, p90, risk, predicted)."""
    cols = [*SERIES, "model", F.col("now_us").alias("made_us"), "used", "status", "burn_per_hour", "eta_us"]
    a = linear_.select(*cols, F.lit(None).cast("bigint").alias("p90_us"), F.lit(None).cast("double").alias("risk"), "predicted_used")
    b = simulated.select(*cols, "p90_us", "risk", "predicted_used")
    return a.unionByName(b)


def told(linear_: DataFrame, simulated: DataFrame, *columns: str) -> DataFrame:
    """Both models' forecasts with only some columns: (series, model, made_us, columns)."""
    cols = [*SERIES, "model", F.col("now_us").alias("made_us"), *columns]
    return linear_.select(*cols).unionByName(simulated.select(*cols))


def watched(spark, tokens: DataFrame, providers=("claude", "codex"), kinds=("weekly", "w5h")) -> DataFrame:
    """The grid of accounts, enabled providers and watched kinds."""
    grid = spark.createDataFrame([(p, k) for p in providers for k in kinds], "provider string, kind string")
    return tokens.select("account").distinct().crossJoin(F.broadcast(grid))  # four rows
