"""Cycle segmentation and reset derivation, keyed by any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnline.dims import DURATION_US, EXHAUSTED, NEAR_ZERO, RESET_DROP, SECOND, STALE_US, by_kind, is_rolling
from burnline.operators.lookups import dealt, over_shards, shard_key


def reset_seen(prev_used: Column, prev_resets: Column) -> Column:
    """Whether a reset lies between the previous reading and this one."""
    drop = (prev_used - F.col("used")) > RESET_DROP
    low = F.col("used") < NEAR_ZERO
    advanced = F.coalesce(F.col("resets_us") > prev_resets + SECOND, F.lit(False))
    fixed = advanced | (drop & (~F.col("is_estimated") | low))
    cleared = drop & low & F.coalesce(F.col("ts_us") >= prev_resets - SECOND, F.lit(False))
    return F.coalesce(F.when(is_rolling(), cleared).otherwise(fixed), F.lit(False))


def linked(history: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """`history`, dealt by shards of time (`_key`), with prev and next (ts_us, used, resets_us) and is_reset; `_end` marks a shard's last reading.

    A shard's first and last reading have their neighbours from the shards beside it, by a pass over one row a shard."""
    w, row = Window.partitionBy("_key").orderBy("ts_us"), F.struct("ts_us", "used", "resets_us")
    rows = dealt(history, keys, "ts_us", n).withColumn("_prev", F.lag(row).over(w)).withColumn("_next", F.lead(row).over(w))
    first, last = (F.struct(pick("ts_us").alias("ts_us"), by("used", "ts_us").alias("used"), by("resets_us", "ts_us").alias("resets_us")) for pick, by in ((F.min, F.min_by), (F.max, F.max_by)))
    edges = history.groupBy(shard_key(keys, "ts_us").alias("_key")).agg(first.alias("_first"), last.alias("_last"))
    edges = edges.select("_key", F.lag("_last").over(over_shards(keys)).alias("_before"), F.lead("_first").over(over_shards(keys)).alias("_after"))
    rows = rows.join(edges, "_key").withColumn("_end", F.col("_next").isNull()).withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    rows = rows.withColumn("prev_ts", F.col("_prev.ts_us")).withColumn("prev_used", F.col("_prev.used")).withColumn("next_ts", F.col("_next.ts_us")).withColumn("next_used", F.col("_next.used"))
    return rows.withColumn("is_reset", reset_seen(F.col("prev_used"), F.col("_prev.resets_us"))).drop("_prev", "_next", "_before", "_after")


def segment(history: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """`history` with prev_ts, prev_used, is_reset and block_id: resets are numbered within shards of time, then from those before."""
    upto = Window.partitionBy("_key").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    rows = linked(history, keys, n).withColumn("_block", F.sum(F.col("is_reset").cast("int")).over(upto))
    earlier = over_shards(keys).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.where("_end").select("_key", F.coalesce(F.sum("_block").over(earlier), F.lit(0)).alias("_base"))
    return rows.join(base, "_key").select(*history.columns, "prev_ts", "prev_used", "is_reset", (F.col("_base") + F.col("_block")).alias("block_id"))


STATE = ["ts_us", "used", "n", "prev_ts", "prev_used", "next_ts", "next_used", "open", "rise", "fall", "full"]
#: What is asked of the state as of retention before a moment.
OLD_STATE = ["n", "next_ts", "next_used"]


def running_state(samples: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Every reading with what its series has come to by then: its number, its neighbours, and the last block start, rise from
    zero, fall, and start of a stay at the cap. None of it depends on who asks, so one sort of a series serves all moments;
    it is sorted by shards of time, and what a shard has come to goes on to the next ones."""
    w = Window.partitionBy("_key").orderBy("ts_us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, what: F.last(F.when(when, what), ignorenulls=True).over(upto)
    rows = linked(samples, keys, n).withColumn("n", F.row_number().over(w).cast("bigint"))
    follows = ~F.col("is_reset") & F.col("prev_ts").isNotNull()
    rows = rows.withColumn("open", last(~follows, F.struct("ts_us", "used", "prev_ts", "n")))
    rows = rows.withColumn("rise", last(follows & (F.col("prev_used") == 0) & (F.col("used") > 0), F.struct("ts_us", "prev_ts")))
    rows = rows.withColumn("fall", last(follows & (F.col("used") < F.col("prev_used")), F.struct("ts_us", "used", "prev_ts")))
    rows = rows.withColumn("full", last((F.col("used") >= EXHAUSTED) & F.coalesce(F.col("prev_used") < EXHAUSTED, F.lit(True)), F.col("ts_us")))
    numbered = lambda base: F.when(F.col("open").isNotNull(), F.struct(*(F.col(f"open.{c}").alias(c) for c in ("ts_us", "used", "prev_ts")), (F.col("open.n") + F.col(base)).alias("n")))
    earlier = over_shards(keys).rowsBetween(Window.unboundedPreceding, -1)
    came = rows.where("_end").select("_key", "n", "open", "rise", "fall", "full").withColumn("_n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("open", numbered("_n"))
    came = came.select("_key", "_n", *(F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in ("open", "rise", "fall", "full")))
    rows = rows.join(came, "_key").withColumn("open", numbered("_n")).withColumn("n", F.col("n") + F.col("_n"))
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in ("open", "rise", "fall", "full")}).drop("_key", "_end", "_n", "_open", "_rise", "_fall", "_full")


def block_facts(found: DataFrame, retention_us: int) -> DataFrame:
    """`found` (now_us; cur and old: the STATE as of now_us and OLD_STATE as of retention before it) with the current block, boundary,
    rise, saturation and calibration span. What is older than retention counts as never read."""
    limit, cur, old = F.col("now_us") - retention_us, F.col("cur"), F.col("old")
    out = found.where(cur.isNotNull() & (cur["ts_us"] > limit))
    clipped = cur["open"]["ts_us"] <= limit
    kept = lambda x: F.coalesce((x["ts_us"] > cur["open"]["ts_us"]) & (x["prev_ts"] > limit), F.lit(False))
    had = ~clipped & F.coalesce(cur["open"]["prev_ts"] > limit, F.lit(False))
    before = F.coalesce(old["n"], F.lit(0))
    first, first_used = F.when(clipped, old["next_ts"]).otherwise(cur["open"]["ts_us"]), F.when(clipped, old["next_used"]).otherwise(cur["open"]["used"])
    rolled = is_rolling() & kept(cur["fall"])
    out = out.withColumns({
        "n_history": (cur["n"] - before).cast("bigint"),
        "n_block": (cur["n"] - F.when(clipped, before).otherwise(cur["open"]["n"] - 1)).cast("bigint"),
        "started_us": F.when(had, first),
        "before_us": F.when(had, cur["open"]["prev_ts"]),
        "block_us": first,
        "first_used": first_used,
        "last_used": cur["used"],
        "last_ts": cur["ts_us"],
        "rise_us": F.when(kept(cur["rise"]), (cur["rise"]["prev_ts"] + cur["rise"]["ts_us"]) / 2),
        "saturated_us": F.when(cur["used"] >= EXHAUSTED, F.when(cur["full"] > limit, cur["full"]).otherwise(old["next_ts"])),
        "span_from": F.when(rolled, cur["fall"]["ts_us"]).otherwise(first),
        "span_used": F.when(rolled, cur["fall"]["used"]).otherwise(first_used),
        "last_rows": F.when(cur["ts_us"] > first, F.array(F.struct(cur["prev_ts"].alias("ts_us"), cur["prev_used"].alias("used")), F.struct(cur["ts_us"].alias("ts_us"), cur["used"].alias("used")))).otherwise(F.array(F.struct(cur["ts_us"].alias("ts_us"), cur["used"].alias("used")))),
    })
    return out.withColumn("boundary_us", (F.col("before_us") + F.col("started_us")) / 2).drop("cur", "old")


def derived_reset(anchor: Column, token_after: Column, any_tokens: Column) -> Column:
    """The reset (micros, double) of a reading that gives none; see the decision table in the survey."""
    dur, now, edge = by_kind(DURATION_US), F.col("now_us"), F.col("boundary_us")
    rise = F.when(now - F.col("rise_us") < dur, F.col("rise_us"))
    after_edge = F.least(F.when(F.col("first_used") > 0, edge), token_after.cast("double"), rise)
    otherwise = F.least(rise, anchor.cast("double"))
    base = edge + dur
    stepped = F.when(base <= now, base + (F.floor((now - base) / dur) + 1) * dur).otherwise(base)
    recent = (F.col("kind") == "w5h") & F.coalesce(now - edge < dur, F.lit(False))
    short = F.when(otherwise.isNotNull(), otherwise + dur).when(any_tokens, F.lit(None).cast("double")).otherwise(stepped)
    return F.when(recent, after_edge + dur).when(F.col("kind") == "w5h", short).otherwise(stepped)


def level_still_in_cycle(resets: Column) -> Column:
    """Whether a stale level still belongs to the current cycle: never on a rolling window or without a reset."""
    dur = by_kind(DURATION_US)
    ok = ~is_rolling() & (F.col("now_us") < resets) & (F.col("source_us") >= resets - dur)
    return F.coalesce(ok, F.lit(False))


def rate_is_stale(stale_us: dict[str, int] = STALE_US) -> Column:
    return (F.col("now_us") - F.col("source_us")) > by_kind(stale_us)
