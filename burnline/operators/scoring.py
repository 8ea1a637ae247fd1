"""Grading forecasts against what happened: truths, scores, calibration and model choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnline.dims import EXHAUSTED, HOUR, MIN_GAIN, MIN_MOMENTS, SERIES
from burnline.operators.lookups import as_of, dealt, over_shards, shard_key, spread
from burnline.operators.projection import clamp
from burnline.storage import written


def with_next_exhaustion(segmented: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """`segmented` with next_full_us, the first later reading at the cap in the same block; and last_block and last_us of its key.

    The latest readings come first, so a running value holds the next reading at the cap; it goes on to earlier shards of time."""
    full = F.when(F.col("used") >= EXHAUSTED, F.col("ts_us"))
    w = Window.partitionBy("_key").orderBy(F.desc("ts_us")).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(segmented, keys, "ts_us", n).withColumn("_full", F.last(F.when(F.col("used") >= EXHAUSTED, F.struct("ts_us", "block_id")), ignorenulls=True).over(w))
    heads = segmented.groupBy(shard_key(keys, "ts_us").alias("_key")).agg(F.min(full).alias("_at"), F.min_by("block_id", full).alias("_in"), F.max("block_id").alias("_block"), F.max("ts_us").alias("_ts"))
    head = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("ts_us"), F.col("_in").alias("block_id")))
    later, whole = over_shards(keys, forward=True).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*(F.col(f"_key.{k}") for k in keys))
    heads = heads.select("_key", F.last(head, ignorenulls=True).over(later).alias("_after"), F.max("_block").over(whole).alias("last_block"), F.max("_ts").over(whole).alias("last_us"))
    next_full = F.coalesce("_full", "_after")
    return rows.join(heads, "_key").withColumn("next_full_us", F.when(next_full["block_id"] == F.col("block_id"), next_full["ts_us"])).drop("_key", "_full", "_after")


def realized_hours() -> Column:
    """Hours from a reading to its block's exhaustion; null at the cap, or where it comes after the declared reset."""
    ok = (F.col("used") < EXHAUSTED) & (F.col("resets_us").isNull() | (F.col("next_full_us") <= F.col("resets_us")))
    return F.when(ok, (F.col("next_full_us") - F.col("ts_us")) / HOUR)


def risk_outcome(segmented: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """`segmented` with outcome: 1 exhausted in its cycle, 0 the cycle ended first, null undecided or already at the cap."""
    rows = with_next_exhaustion(segmented, keys, n)
    ended = (F.col("block_id") < F.col("last_block")) | F.coalesce(F.col("last_us") > F.col("resets_us"), F.lit(False))
    return rows.withColumn("realized_h", realized_hours()).withColumn("outcome", F.when(F.col("used") >= EXHAUSTED, F.lit(None)).when(F.col("realized_h").isNotNull(), 1).when(ended, 0))


def used_at(moments: DataFrame, segmented: DataFrame, keys: list[str], at: str, target: str, n: int | None = None) -> DataFrame:
    """`moments` with origin (its sample) and truth: the level at `target` in the origin's cycle, interpolated.

    Null where the target is before the origin or after its reset, where a reset
    lies between, and where data end first."""
    cols = ["used", "resets_us", "block_id"]
    m = written(as_of(moments, segmented, keys, at, cols, "origin", n=n))
    m = m.withColumn("_before", F.col(target) - 1)
    m = written(as_of(m, segmented, keys, target, cols, "_next", forward=True, n=n))
    m = as_of(m, segmented, keys, "_before", cols, "_prev", n=n)
    o, p, n, t = F.col("origin"), F.col("_prev"), F.col("_next"), F.col(target)
    same = (n["block_id"] == o["block_id"]) & (n["ts_us"] > o["ts_us"])
    share = (t - p["ts_us"]) / (n["ts_us"] - p["ts_us"])
    inside = F.when(n["ts_us"] == t, n["used"]).otherwise(p["used"] + share * (n["used"] - p["used"]))
    truth = F.when(o.isNull() | (t < o["ts_us"]), F.lit(None)).when(t == o["ts_us"], o["used"]).when(o["resets_us"].isNotNull() & (t > o["resets_us"]), F.lit(None)).when(same, inside)
    return m.withColumn("truth", truth).drop("_before", "_next", "_prev")


def matched_moments(forecasts: DataFrame, models: list[str], horizon_h: Column, keys: list[str], legacy: bool = True, n_tasks: int | None = None) -> DataFrame:
    """Moments (keys, made_us) where every model answered once, fit to be compared, with its prediction.

    All predictions recorded, or (legacy) none and then used + burn * h, clamped."""
    rows = forecasts.where(F.col("model").isin(models))
    rows = spread(rows, n_tasks, *keys, "made_us") if n_tasks else rows
    moment = rows.groupBy(*keys, "made_us").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("model").alias("k"),
        F.sum(F.when(F.coalesce(F.col("status") == "OK", F.lit(False)) & (F.col("used") < EXHAUSTED), 1).otherwise(0)).alias("fit"),
        F.count("predicted_used").alias("recorded"),
        F.count("burn_per_hour").alias("rated"),
    )
    n = len(models)
    fallback = (F.col("recorded") == 0) & (F.col("rated") == n) if legacy else F.lit(False)
    moment = moment.where((F.col("n") == n) & (F.col("k") == n) & (F.col("fit") == n) & ((F.col("recorded") == n) | fallback)).select(*keys, "made_us", "recorded")
    out = rows.join(moment, [*keys, "made_us"])
    return out.withColumn("prediction", F.when(F.col("recorded") > 0, F.col("predicted_used")).otherwise(clamp(F.col("used") + F.col("burn_per_hour") * horizon_h))).drop("recorded")


def dense_errors(forecasts: DataFrame, segmented: DataFrame, models: list[str], horizon_us: Column, keys: list[str] = SERIES, legacy: bool = True, n: int | None = None) -> DataFrame:
    """Rows of matched moments whose truth is known, with error and level_error: those of the prediction and of the level staying."""
    rows = matched_moments(forecasts, models, horizon_us / float(HOUR), keys, legacy, n and n * len(models))
    moments = written(rows.select(*keys, "made_us").distinct()).withColumn("target_us", F.col("made_us") + horizon_us)  # a lookup reads them twice
    truths = used_at(moments, segmented, keys, "made_us", "target_us", n).where("truth IS NOT NULL").select(*keys, "made_us", "truth", F.col("origin.used").alias("origin_used"))
    return rows.join(truths, [*keys, "made_us"]).withColumn("error", F.col("prediction") - F.col("truth")).withColumn("level_error", F.col("origin_used") - F.col("truth"))


def dense_scores(forecasts: DataFrame, segmented: DataFrame, models: list[str], horizon_us: Column, by: list[str], keys: list[str] = SERIES, legacy: bool = True, n: int | None = None) -> DataFrame:
    """(by, model, moments, mae, bias, persistence_mae) over matched moments whose truth is known."""
    rows = dense_errors(forecasts, segmented, models, horizon_us, keys, legacy, n)
    return rows.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("moments"), F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"), F.avg(F.abs("level_error")).alias("persistence_mae"))


def pool_scores(scores: DataFrame) -> DataFrame:
    """Moment-weighted means over window kinds; empty scores don't count."""
    s = scores.where("moments > 0 AND mae IS NOT NULL")
    mean = lambda c: (F.sum(F.col(c) * F.col("moments")) / F.sum("moments")).alias(c)
    return s.groupBy("model").agg(F.sum("moments").alias("moments"), mean("mae"), mean("bias"), mean("persistence_mae"))


def episode_scores(forecasts: DataFrame, outcomes: DataFrame, keys: list[str] = SERIES, n: int | None = None) -> DataFrame:
    """(model, moments, answered, episodes, mae_h, bias_h): ETAs against the instant of exhaustion.

    Moments exclude stale, pending and absent readings; an unknown status counts. `forecasts` hold risk, or say whether they answered."""
    keep = F.coalesce(~F.col("status").isin("IDLE", "NO_DATA", "RESET_PENDING"), F.lit(True))
    m = as_of(forecasts.where(keep), outcomes, keys, "made_us", ["used", "realized_h"], "o", n=n and 2 * n).where("o IS NOT NULL")
    actual = F.col("o.ts_us") + F.col("o.realized_h") * HOUR
    error = F.when(F.col("o.realized_h").isNotNull(), (F.col("eta_us") - actual) / HOUR)
    answered = F.col("answered") if "answered" in forecasts.columns else F.col("eta_us").isNotNull() | F.col("risk").isNotNull()
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("moments"), F.count(F.when(answered, 1)).alias("answered"), F.count(error).alias("episodes"), F.avg(F.abs(error)).alias("mae_h"), F.avg(error).alias("bias_h"))


def answer_coverage() -> Column:
    return F.when(F.col("moments") > 0, F.col("answered") / F.col("moments")).otherwise(F.lit(0.0))


def brier(p: Column, outcome: Column) -> Column:
    return F.avg(F.pow(p - outcome, 2))


def reliability(rows: DataFrame, p: str = "risk", outcome: str = "outcome") -> DataFrame:
    """(low, high, n, frequency) for each band of claimed risk that has claims."""
    bands = [(0.0, 0.3), (0.3, 0.6), (0.6, 0.9), (0.9, 1.01)]
    low = reduce(lambda c, b: c.when((F.col(p) >= b[0]) & (F.col(p) < b[1]), b[0]), bands, F.when(F.lit(False), F.lit(None).cast("double")))
    high = reduce(lambda c, b: c.when((F.col(p) >= b[0]) & (F.col(p) < b[1]), b[1]), bands, F.when(F.lit(False), F.lit(None).cast("double")))
    return rows.withColumn("low", low).withColumn("high", high).where("low IS NOT NULL").groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("frequency"))


def choose_model(scores: DataFrame, default: str = "linear") -> DataFrame:
    """One row (chosen, challenger, reason, gain, over_persistence): the default unless a challenger passes every gate."""
    rival = scores.where((F.col("model") != default) & (F.col("model") != "persistence") & F.col("mae").isNotNull())
    best = rival.agg(F.min_by(F.struct("model", "moments", "mae", "persistence_mae"), F.struct("mae", "model")).alias("w"))
    base = scores.where(F.col("model") == default).agg(F.max("mae").alias("base_mae"))  # one row, null without a score
    row = best.crossJoin(base)
    w, gain, over = F.col("w"), (F.col("base_mae") - F.col("w.mae")) / F.col("base_mae"), (F.col("w.persistence_mae") - F.col("w.mae")) / F.col("w.persistence_mae")
    reason = (
        F.when(w.isNull(), "no challenger has a score")
        .when(w["moments"] < MIN_MOMENTS, "too few moments")
        .when(F.col("base_mae").isNull(), "the default has no score")
        .when(F.col("base_mae") == 0, "the default is exact")
        .when(gain < MIN_GAIN, "gain over the default is under the margin")
        .when(w["persistence_mae"].isNull(), "no persistence score")
        .when(w["persistence_mae"] == 0, "persistence is exact")
        .when(over < MIN_GAIN, "gain over persistence is under the margin")
        .otherwise("passes every gate")
    )
    row = row.withColumn("reason", reason)
    return row.select(F.when(F.col("reason") == "passes every gate", w["model"]).otherwise(F.lit(default)).alias("chosen"), w["model"].alias("challenger"), "reason", F.when(F.col("base_mae") > 0, gain).alias("gain"), F.when(w["persistence_mae"] > 0, over).alias("over_persistence"))


def kind_veto(per_kind: DataFrame, winner: str, default: str = "linear") -> DataFrame:
    """Kinds in which the winner, well measured, is worse than the default by the margin; any row vetoes."""
    a = per_kind.where(F.col("model") == winner).select("kind", "moments", F.col("mae").alias("winner_mae"))
    b = per_kind.where(F.col("model") == default).select("kind", F.col("mae").alias("default_mae"))
    worse = (F.col("winner_mae") - F.col("default_mae")) / F.col("default_mae")
    return a.join(b, "kind").where((F.col("moments") >= MIN_MOMENTS) & (F.col("default_mae") != 0)).where(worse >= MIN_GAIN).withColumn("worse", worse)


def graded_choice(per_kind: DataFrame, default: str = "linear") -> DataFrame:
    """One row: choose_model's over the pooled scores, taken back where the winner is worse on a window kind; vetoed_by names it."""
    row = choose_model(pool_scores(per_kind), default)
    winner = per_kind.join(F.broadcast(row.select(F.col("challenger").alias("model"))), "model").select("kind", "moments", F.col("mae").alias("winner_mae"))  # one row
    base = per_kind.where(F.col("model") == default).select("kind", F.col("mae").alias("default_mae"))
    worse = (F.col("winner_mae") - F.col("default_mae")) / F.col("default_mae")
    veto = winner.join(base, "kind").where((F.col("moments") >= MIN_MOMENTS) & (F.col("default_mae") != 0)).where(worse >= MIN_GAIN).agg(F.max_by("kind", worse).alias("vetoed_by"))
    out = row.crossJoin(F.broadcast(veto))  # one row each
    passed = F.col("reason") == "passes every gate"
    stopped = passed & F.col("vetoed_by").isNotNull()
    return out.select(F.when(passed & ~stopped, F.col("challenger")).otherwise(F.lit(default)).alias("chosen"), "challenger", F.when(stopped, "worse on a window kind").otherwise(F.col("reason")).alias("reason"), "vetoed_by", "gain", "over_persistence")


def gradable(forecasts: DataFrame, samples: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """`forecasts` of the series that have three readings at least: others can't be graded."""
    enough = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select(*keys)
    return forecasts.join(F.broadcast(enough), keys, "left_semi")  # a row a series; dealing forecasts by series would bring each to one task


MODELS = ("linear", "montecarlo")


def select_model(name: str, scores: DataFrame | None, per_kind: DataFrame | None = None, default: str = "linear") -> tuple[str, str]:
    """(model, why): an explicit name wins, an unknown one fails, `auto` goes by the scores (a few rows)."""
    if name != "auto":
        if name not in MODELS:
            raise ValueError(f"unknown model {name!r}; there are {', '.join(MODELS)}")
        return name, "named in the settings"
    if scores is None:
        return default, "no stored forecasts"
    row = choose_model(scores, default).first()
    if row.chosen != default and per_kind is not None and (bad := kind_veto(per_kind, row.chosen, default).orderBy(F.desc("worse")).first()):
        return default, f"{row.chosen} is worse on {bad.kind}"
    return row.chosen, row.reason
