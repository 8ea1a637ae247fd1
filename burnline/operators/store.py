"""Sinks and lookups of the stored tables: keep-first and keep-last writes, floors, ranges, retention.

Stored tables are Parquet folders; functions return the table's next contents or
write them, and never collect rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_KEY = ["account", "provider", "kind", "ts_us"]
EVENT_KEY = ["provider", "request_id", "message_id"]


def keep_first(new: DataFrame, existing: DataFrame | None, key: list[str], order: str | Column) -> DataFrame:
    """The rows of `new` to append: the first of each key, unless the key is stored already."""
    first = new.groupBy(*key).agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*")
    return first if existing is None else first.join(existing.select(*key), key, "left_anti").select(new.columns)


def keep_last(events: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row for each key: the last by `order` (file, then line)."""
    return events.groupBy(*key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Stored rows with new ones written over them."""
    last = keep_last(new, key, order).select(existing.columns)
    return existing.join(last.select(*key), key, "left_anti").select(existing.columns).unionByName(last)


def above_floor(rows: DataFrame, floor: Column | float | None, ts: str = "ts_us") -> DataFrame:
    """Rows at or after the history floor; without one, all."""
    return rows.where(F.col(ts) >= F.coalesce(floor if isinstance(floor, Column) else F.lit(floor), F.lit(0)))


def recent(rows: DataFrame, since: Column | int, ts: str, ties: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """Rows of one provider (and kind) from `since` on, oldest first."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.where(F.col(ts) >= since).orderBy(ts, *ties)


def latest_barrier(forecasts: DataFrame, at: Column | int, keys: list[str]) -> DataFrame:
    """Each key's newest forecast at or before `at` that is not idle (an unknown status is passed over)."""
    return forecasts.where((F.col("made_us") <= at) & (F.col("status") != "IDLE")).groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct("made_us", "id")).alias("r")).select("r.*")


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key), key, "left_anti").select(rows.columns)


def prune(rows: DataFrame, cutoff: Column | int, ts: str = "ts_us") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff)


def reset_history(tables: dict[str, DataFrame], now: float) -> tuple[DataFrame, dict[str, DataFrame], float]:
    """(one row with `removed`, the emptied tables, the new history floor)."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")) for t in tables.values()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total.agg(F.sum("n").alias("removed")), {k: t.limit(0) for k, t in tables.items()}, now


def total_tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation") + F.col("cache_read")


def last_n(rows: DataFrame, n: int, keys: list[str], ts: str) -> DataFrame:
    """The newest n rows of each key: for reports of bounded length."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
