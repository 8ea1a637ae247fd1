"""Folds over candidate readings and read attempts, and source selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnline.dims import RESET_TIE_US, SECOND
from burnline.operators.folds import ordered_fold


def arbitrate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The winning reading of each key among candidates (ts_us, used, resets_us) taken in order of `rank`.

    A challenger wins with a reset later by over a minute; with a known reset against
    an unknown one; else (both unknown, or resets alike) when it is strictly newer.
    The tolerance makes this order-dependent, so it is a fold, not a maximum."""
    row = F.struct("rank", F.col("ts_us").cast("bigint").alias("ts_us"), "used", F.col("resets_us").cast("bigint").alias("resets_us"))
    rows = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("c"))
    wins = f"""CASE WHEN x.resets_us IS NOT NULL AND s.resets_us IS NOT NULL AND abs(x.resets_us - s.resets_us) > {RESET_TIE_US} THEN x.resets_us > s.resets_us
        WHEN (x.resets_us IS NULL) <> (s.resets_us IS NULL) THEN x.resets_us IS NOT NULL
        ELSE x.ts_us > s.ts_us END"""
    return rows.select(*keys, F.expr(f"aggregate(slice(c, 2, size(c)), c[0], (s, x) -> IF({wins}, x, s))").alias("r")).select(*keys, "r.rank", "r.ts_us", "r.used", "r.resets_us")


def throttle(attempts: DataFrame, keys: list[str], every_s: int = 180, most_s: int = 1800, keep_s: int = 900) -> DataFrame:
    """Replays reads (ts_us, ok) through the throttle: tried, the wait after it, and whether a cached reading is served.

    A try waits for `every_s` after the last; each failure doubles the wait up to
    `most_s`, a success restores it; a success is served for less than `keep_s`."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        due, wait, good = state
        at, tried = row["ts_us"], row["ts_us"] >= due
        if tried:
            wait = every_s if row["ok"] else min(wait * 2, most_s)
            due, good = at + wait * SECOND, at if row["ok"] else good
        return (due, wait, good), {"ts_us": at, "tried": tried, "wait_s": wait, "served": good is not None and good > at - keep_s * SECOND}

    return ordered_fold(attempts.select(*keys, "ts_us", "ok"), keys, ["ts_us", "ok"], (-1, every_s, None), step, "ts_us bigint, tried boolean, wait_s bigint, served boolean")


def choose_source(readings: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """One reading for each key from those of `source` desktop, cli and tokens.

    A named source stands alone. Otherwise live text wins over the desktop file,
    and token estimates are used only by accounts that have neither."""
    if mode != "auto":
        return readings.where(F.col("source") == mode)
    order = F.when(F.col("source") == "cli", 2).when(F.col("source") == "desktop", 1).otherwise(0)
    account = [k for k in keys if k != "kind"]
    ranked = readings.withColumn("_order", order)
    best = ranked.groupBy(*account).agg(F.max("_order").alias("_top"))
    kept = ranked.join(best, account).where((F.col("_order") > 0) | (F.col("_top") == 0))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*readings.columns), "_order").alias("r")).select("r.*")
